"""The store against hand-checked scenarios and a model of versions."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import timeline
from tempora.operators.timeline import FOREVER, BeforeHistory
from tempora.plans.sql import Session
from tempora.sources.store import Store, StoreError
from tempora.streaming.ingest import upsert_stream


class Clock:
    def __init__(self, at=100):
        self.at = at

    def __call__(self):
        return self.at


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), clock=Clock())
    s.create("acct", [("id", "int"), ("balance", "int")])
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def df(spark, data, schema="id int, balance int"):
    return spark.createDataFrame(data, schema)


def test_deletion_gap_and_logical_drop(spark, store):
    times = []
    for i, f in enumerate(
        (
            lambda: store.insert("acct", df(spark, [(1, 10)])),
            lambda: store.update("acct", {"balance": 20}, key=1),
            lambda: store.update("acct", {"balance": F.col("balance") + 10}),
            lambda: store.delete("acct", key=1),
            lambda: store.insert("acct", df(spark, [(1, 40)])),
        )
    ):
        store.clock.at = 200 + 100 * i
        assert f() == 1
        times.append(store.manifests()[-1]["at"])
    t0, t1, t2, t3, t4 = times
    got = rows(timeline.system_range(store.history("acct"), 0, 10_000, raw=True))
    assert got == sorted([(1, 10, t0, t1), (1, 20, t1, t2), (1, 30, t2, t3), (1, 40, t4, FOREVER)], key=str)
    assert rows(store.read("acct", t3)) == [] and rows(store.read("acct", t3 - 1)) == [(1, 30)]
    h = timeline.history(store.history("acct"), 1).orderBy("sys_from").collect()
    assert [r.op for r in h] == ["INSERT", "UPDATE", "UPDATE", "INSERT"] and [r.current for r in h] == [False] * 3 + [True]
    assert h[0]["_prov_principal"] == "local" and h[0]["_prov_committed_at"] == t0
    store.clock.at = 900
    store.drop("acct")
    assert rows(store.read("acct", t4)) == [(1, 40)]
    with pytest.raises(StoreError):
        store.read("acct")
    with pytest.raises(BeforeHistory):
        store.read("acct", 1)


def test_rejected_writes(spark, store):
    store.insert("acct", df(spark, [(1, 10), (2, None)]))
    for bad, state in (([(1, 5)], "23505"), ([(None, 5)], "23502"), ([(7, 1), (7, 2)], "23505")):
        with pytest.raises(StoreError) as e:
            store.insert("acct", df(spark, bad))
        assert e.value.sqlstate == state
    with pytest.raises(StoreError):
        store.update("acct", {"balance": 1}, key=99)
    with pytest.raises(StoreError):
        store.update("acct", {"id": 1})
    assert store.update("acct", {"balance": 1}, F.col("id") > 50) == 0
    assert rows(store.read("acct")) == [(1, 10), (2, None)]


def test_merge(spark, store):
    store.insert("acct", df(spark, [(1, 10), (2, 20)]))
    src = df(spark, [(1, 100), (3, 300), (None, 5)], "k int, v int").where("k IS NOT NULL")
    assert store.merge("acct", src, "k", {"balance": "v"}, {"id": "k", "balance": "v"}) == 2
    assert rows(store.read("acct")) == [(1, 100), (2, 20), (3, 300)]
    with pytest.raises(StoreError) as e:
        store.merge("acct", df(spark, [(1, 1), (1, 2)], "k int, v int"), "k", {"balance": "v"}, None)
    assert e.value.sqlstate == "21000"
    with pytest.raises(StoreError) as e:
        store.merge("acct", df(spark, [(None, 1)], "k int, v int"), "k", None, {"id": "k", "balance": "v"})
    assert e.value.sqlstate == "23502"
    assert store.merge("acct", df(spark, [(None, 1), (9, 9)], "k int, v int"), "k", {"balance": "v"}, None) == 0


def test_valid_time(spark, store):
    store.create("v", [("id", "int"), ("b", "int"), ("vf", "bigint"), ("vt", "bigint")], ("vf", "vt"))
    schema = "id int, b int, vf bigint, vt bigint"
    store.insert("v", df(spark, [(1, 1, 10, 20), (2, 2, 5, None)], schema))
    with pytest.raises(StoreError):
        store.insert("v", df(spark, [(3, 1, 20, 20)], schema))
    with pytest.raises(StoreError):
        store.update("v", {"b": 3})
    with pytest.raises(StoreError):
        store.insert("v", df(spark, [(4, 4)], "id int, b int"))
    now = store.now()
    assert rows(store.read("v", now, 10)) == [(1, 1), (2, 2)] and rows(store.read("v", now, 20)) == [(2, 2)]
    store.merge("v", df(spark, [(1, 9, 30, 40), (3, 3, 7, 8)], schema), "id", {"b": "b", "vf": "vf", "vt": "vt"}, {"id": "id", "b": "b", "vf": "vf", "vt": "vt"})
    assert rows(timeline.valid_range(store.history("v"), store.now(), 30, 31)) == [(1, 9, 30, 40), (2, 2, 5, None)]
    assert rows(store.read("v", now, 15)) == [(1, 1), (2, 2)]  # a later fact changes no earlier read


def test_transactions(spark, store):
    store.insert("acct", df(spark, [(1, 10), (2, 20)]))
    t, u = store.begin(), store.begin()
    t.update("acct", {"balance": 11}, key=1)
    t.savepoint("s")
    t.delete("acct", key=2)
    assert rows(t.read("acct")) == [(1, 11)]
    t.rollback_to("s")
    t.insert("acct", df(spark, [(5, 50)]))
    t.delete("acct", key=5)
    assert rows(t.read("acct")) == [(1, 11), (2, 20)] and rows(u.read("acct")) == [(1, 10), (2, 20)]
    t.commit()
    assert rows(store.read("acct")) == [(1, 11), (2, 20)]
    u.update("acct", {"balance": 99}, key=1)
    with pytest.raises(StoreError) as e:
        u.commit()
    assert e.value.sqlstate == "40001"
    w = store.begin()
    w.update("acct", {"balance": 21}, key=2)
    store.update("acct", {"balance": 12}, key=1)
    w.commit()
    assert rows(store.read("acct")) == [(1, 12), (2, 21)]


def test_chain_audit_compact_backup_copy(spark, store, tmp_path):
    store.insert("acct", df(spark, [(1, 10)]))
    head = store.verify_chain()[2]
    store.update("acct", {"balance": 11})
    before = rows(timeline.system_range(store.history("acct"), 0, 10_000))
    store.compact("acct")
    assert rows(timeline.system_range(store.history("acct"), 0, 10_000)) == before
    assert store.verify_chain(head)[0] and not store.verify_chain("ff" * 32)[0]
    assert all(r.linked for r in store.audit("acct").collect()) and store.segments("acct").count() >= 1
    (tmp_path / "in.csv").write_text("id,balance\n7,70\n8,\n")
    assert store.copy_from("acct", str(tmp_path / "in.csv"), format="csv", header=True) == 2
    (tmp_path / "bad.csv").write_text("9,90\nx,1\n")
    with pytest.raises(Exception):
        store.copy_from("acct", str(tmp_path / "bad.csv"), format="csv")
    assert rows(store.read("acct")) == [(1, 11), (7, 70), (8, None)]
    store.backup(str(tmp_path / "copy"))
    again = Store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "again"), clock=store.clock)
    assert rows(again.read("acct")) == rows(store.read("acct")) and rows(again.read("acct", 103)) == rows(store.read("acct", 103))
    with pytest.raises(StoreError):
        Store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "again"))
    copy = Store(spark, str(tmp_path / "copy"), clock=store.clock)
    assert rows(copy.read("acct")) == rows(store.read("acct")) and copy.catalog().count() == 2
    log = tmp_path / "copy" / "_commits" / "000000000002.json"
    (log.parent / f".{log.name}.crc").unlink(missing_ok=True)
    log.write_text(log.read_text().replace('"principal": "local"', '"principal": "other"').replace('"at": ', '"at": 1'))
    assert not Store(spark, str(tmp_path / "copy")).verify_chain()[0]
    with pytest.raises(StoreError):
        Store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "third"))


def test_sealed_versions_prune_on_both_bounds(spark, store):
    """After compaction reads, ranges, writes and histories are as before, and what is sealed is read without a shuffle."""
    ats = []
    store.insert("acct", df(spark, [(i, i) for i in range(6)]))
    for _ in range(2):
        store.update("acct", {"balance": F.col("balance") + 10}, F.col("id") < 3)
        ats.append(store.now())
    store.delete("acct", key=1)
    store.delete("acct", key=5)
    ats.append(store.now())
    look = lambda: ([rows(store.read("acct", a)) for a in ats], rows(timeline.system_range(store.history("acct"), 0, 10_000)), rows(timeline.history(store.history("acct"))))
    before = look()
    store.compact("acct")
    assert look() == before and {r.state for r in store.segments("acct").collect()} == {"open", "sealed"}
    store.insert("acct", df(spark, [(1, 100)]))
    store.update("acct", {"balance": 7}, key=2)
    store.compact("acct")
    assert look()[0] == before[0] and rows(store.read("acct")) == [(0, 20), (1, 100), (2, 7), (3, 3), (4, 4)]
    sealed = timeline.as_of(store.history("acct"), ats[0]).explain  # the plan's sealed side
    import contextlib, io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        sealed("formatted")
    assert "LessThanOrEqual(sys_from" in out.getvalue() and "GreaterThan(sys_to" in out.getvalue()


def test_two_open_transactions(spark, store):
    """Numbers are the commits' own, the audit has one row a version, and a read as of now never changes."""
    t, u = store.begin(), store.begin()
    t.insert("acct", df(spark, [(1, 10)]))
    u.insert("acct", df(spark, [(2, 20)]))
    store.clock.at = 500
    t.commit()
    at, seen = store.now(), rows(store.read("acct"))
    store.clock.at = 50
    u.commit()
    assert rows(store.read("acct", at)) == seen == [(1, 10)] and rows(store.read("acct")) == [(1, 10), (2, 20)]
    audit = store.audit("acct").collect()
    assert len(audit) == 2 and len({r["_prov_txn_id"] for r in audit}) == 2 and all(r.linked for r in audit)
    assert not store.files.create(f"{store.root}/_commits/000000000001.json", "{}")


def test_random_model(spark, store):
    """Seeded writes against a list of versions; every instant's read must agree."""
    rnd, model, live = random.Random(7), [], {}
    for _ in range(10):
        store.clock.at += rnd.randrange(5)
        key, op = rnd.randrange(3), rnd.choice(["up", "del"])
        if op == "up" and key not in live:
            store.insert("acct", df(spark, [(key, rnd.randrange(100))]))
        elif op == "up":
            store.update("acct", {"balance": rnd.randrange(100)}, key=key)
        elif key in live:
            store.delete("acct", key=key)
        else:
            continue
        live = {r.id: r.balance for r in store.read("acct").collect()}
        model.append((store.manifests()[-1]["at"], dict(live)))
    for at, expected in model:
        assert {r.id: r.balance for r in store.read("acct", at).collect()} == expected


def test_sql_over_a_store(spark, store):
    store.insert("acct", df(spark, [(1, 10), (2, 20)]))
    before = store.now()
    store.update("acct", {"balance": 11}, key=1)
    s = Session(spark, store.clock)
    s.register("acct", store.history("acct"))
    s.resolve = lambda name, at: store.history(name)
    store.clock.at = store.now() + 1
    assert rows(s.sql("SELECT id, balance FROM acct WHERE balance > 10")) == [(1, 11), (2, 20)]
    assert rows(s.sql(f"SELECT a.balance FROM acct a FOR SYSTEM_TIME AS OF {before} WHERE a.id = 1")) == [(10,)]
    s.sql(f"SET system_time = {before}")
    assert rows(s.sql("SELECT balance FROM acct WHERE id = 1")) == [(10,)]
    s.sql("RESET system_time")
    assert rows(s.sql("SELECT _prov_principal, id FROM acct WHERE id = 1")) == [("local", 1)]


def test_stream(spark, store, tmp_path):
    df(spark, [(1, 5, 1), (1, 6, 2), (2, 7, 1)], "id int, balance int, n int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, balance int, n int").parquet(str(tmp_path / "in"))
    q = upsert_stream(stream, store, "acct", "id", ["n"], str(tmp_path / "ckpt"), once=True)
    q.awaitTermination(120)
    assert rows(store.read("acct")) == [(1, 6), (2, 7)]
    n = len(store.manifests())
    for f in (tmp_path / "ckpt" / "commits").iterdir():  # as if the stream had died before it noted its batch
        f.unlink()
    upsert_stream(spark.readStream.schema("id int, balance int, n int").parquet(str(tmp_path / "in")), store, "acct", "id", ["n"], str(tmp_path / "ckpt"), once=True).awaitTermination(120)
    assert len(store.manifests()) == n and store.history("acct").versions.count() == 2
