"""An append-only bitemporal store on Parquet: catalog, writes, provenance, commit chain.

A commit writes its version and retraction files first and becomes visible by one manifest, `_commits/<seq>.json`, put
in place by a rename that fails if another writer took the number: then the writer's key set is checked against what
came between (first committer wins). Manifests name data folders, carry the schema changes and form a hash chain. A
transaction's number is its commit's. Reads without an instant are as of the last commit, so no commit that is being written
can fall before one. Write sets are computed by joins against the snapshot; nothing but counts and manifests reaches the driver.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import timeline
from ..operators.timeline import FOREVER, BeforeHistory, History, TemporalError
from .files import Files

#: SQL spellings of column types.
TYPES = {
    "INT": "int", "INTEGER": "int", "INT4": "int", "BIGINT": "bigint", "INT8": "bigint", "TEXT": "string", "VARCHAR": "string", "BOOL": "boolean",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "DATE": "date", "UUID": "string", "BYTEA": "binary",
}


class StoreError(TemporalError):
    """A write that is rejected; `sqlstate` says why."""

    def __init__(self, message: str, sqlstate: str = "22000"):
        super().__init__(message)
        self.sqlstate = sqlstate


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[tuple[str, str], ...]
    valid: tuple[str, str] | None = None

    @property
    def key(self) -> str:
        return self.columns[0][0]

    @property
    def payload(self) -> list[str]:
        return [c for c, _ in self.columns if c not in (self.valid or ())]

    def version_schema(self) -> T.StructType:
        own = [f"`{c}` {t}" for c, t in self.columns if c not in (self.valid or ())]
        period = ["valid_from bigint", "valid_to bigint"] if self.valid else []
        more = ["sys_from bigint", "seq bigint", *period, "_prov_txn_id bigint", "_prov_committed_at bigint", "_prov_principal string"]
        return T._parse_datatype_string(", ".join([*own, *more]))

    def sealed_schema(self) -> T.StructType:
        return self.version_schema().add("sys_to", T.LongType())

    def retraction_schema(self) -> T.StructType:
        kind = dict(self.columns)[self.key]
        return T._parse_datatype_string(f"`{self.key}` {kind}, sys_from bigint, seq bigint, closed_at bigint, _prov_txn_id bigint, _prov_principal string")


def chain_hash(txn: int, at: int, seq: int, prev: str) -> str:
    """SHA-256 of a commit's 56-byte record: txn id, commit time, sequence number, predecessor's hash."""
    return hashlib.sha256(struct.pack(">QqQ", txn, at, seq) + bytes.fromhex(prev)).hexdigest()


GENESIS = "00" * 32


class Store:
    def __init__(self, spark: SparkSession, root: str, principal: str = "local", clock=None):
        self.spark, self.root, self.principal = spark, root.rstrip("/"), principal
        self.files = Files(spark)
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self._manifests: list[dict] = []

    # --- catalog and snapshots ---

    def manifests(self) -> list[dict]:
        names = [n for n in self.files.names(f"{self.root}/_commits") if n.endswith(".json")]
        for n in names[len(self._manifests) :]:
            self._manifests.append(json.loads(self.files.read(f"{self.root}/_commits/{n}")))
        return self._manifests

    def now(self) -> int:
        """The instant of the last commit: what is read as of it never changes."""
        return self.manifests()[-1]["at"] if self.manifests() else self.clock()

    def resolve(self, name: str, at: int = FOREVER) -> TableDef:
        """The table's definition as of `at`: a dropped table is still there before its drop."""
        if not self.manifests() or self.manifests()[0]["at"] > at:
            raise BeforeHistory(f"nothing was committed before {at}")
        found = None
        for m in self.manifests():
            if m["at"] > at:
                break
            for d in m.get("ddl", []):
                if d["name"] == name:
                    valid = tuple(d["valid"]) if d.get("valid") else None
                    found = TableDef(name, tuple(map(tuple, d["columns"])), valid) if d["op"] != "drop" else None
        if found is None:
            raise StoreError(f"no such table: {name}", "42P01")
        return found

    def tables(self, at: int = FOREVER) -> list[str]:
        live: dict[str, bool] = {}
        for m in self.manifests():
            if m["at"] <= at:
                live |= {d["name"]: d["op"] != "drop" for d in m.get("ddl", [])}
        return sorted(n for n, there in live.items() if there)

    def catalog(self) -> DataFrame:
        """(table_name, column_name, position, type, is_key): the live tables' columns."""
        rows = [(n, c, i + 1, t, i == 0) for n in self.tables() for i, (c, t) in enumerate(self.resolve(n).columns)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, position int, type string, is_key boolean")

    def _folders(self, name: str, kind: str, at: int = FOREVER) -> list[str]:
        out = []
        for m in self.manifests():
            if m["at"] > at:
                break
            for d in m.get("ddl", []):
                if d["name"] == name and d["op"] == "create":
                    out = []
            replaced = m.get("replaces", {}).get(name, {}).get(kind)
            if replaced is not None:
                out = []
            out += [f"{self.root}/{p}" for p in m.get(kind, {}).get(name, [])]
        return out

    def history(self, name: str, at: int = FOREVER) -> History:
        d = self.resolve(name, at)

        def log(kind: str, schema: T.StructType) -> DataFrame:
            folders = self._folders(name, kind, at)
            return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

        sealed = log("sealed", d.sealed_schema()) if self._folders(name, "sealed", at) else None
        return History(log("versions", d.version_schema()), d.key, tuple(d.payload), log("retractions", d.retraction_schema()), d.valid is not None, sealed)

    def read(self, name: str, at: int | None = None, valid_at: int | None = None) -> DataFrame:
        at = self.now() if at is None else at
        return timeline.as_of(self.history(name, at), at, valid_at)

    # --- DDL ---

    def create(self, name: str, columns: list[tuple[str, str]], valid: tuple[str, str] | None = None) -> int:
        if name in self.tables():
            raise StoreError(f"table exists: {name}", "42P07")
        if valid and not set(valid) <= {c for c, _ in columns[1:]}:
            raise StoreError("VALID TIME names columns of the table beside its key")
        return self._commit(ddl=[{"op": "create", "name": name, "columns": columns, "valid": valid}])

    def add_column(self, name: str, column: str, kind: str) -> int:
        d = self.resolve(name)
        return self._commit(ddl=[{"op": "alter", "name": name, "columns": [*d.columns, (column, kind)], "valid": d.valid}])

    def drop(self, name: str, if_exists: bool = False) -> int | None:
        if name not in self.tables():
            if if_exists:
                return None
            raise StoreError(f"no such table: {name}", "42P01")
        return self._commit(ddl=[{"op": "drop", "name": name, "columns": []}])

    # --- commits ---

    def _commit(self, txn: Transaction | None = None, ddl: list[dict] | None = None, replaces: dict | None = None, data: dict | None = None, seen: int | None = None) -> int:
        for _ in range(50):
            before = self.manifests()
            seq = len(before) + 1
            at = max(self.clock(), (before[-1]["at"] if before else 0) + 1)
            if seen is not None and len(before) != seen:
                raise StoreError("the table changed while it was rewritten", "40001")
            number = seq
            prev = before[-1]["hash"] if before else GENESIS
            body = {"seq": seq, "txn": number, "at": at, "principal": self.principal, "prev": prev, "hash": chain_hash(number, at, seq, prev), "ddl": ddl or []}
            if data:
                body |= data
            if replaces:
                body["replaces"] = replaces
            if txn:
                txn.check()
                body |= txn.write(at, seq)
                if txn.batch:
                    body["batch"] = txn.batch
            if self.files.create(f"{self.root}/_commits/{seq:012d}.json", json.dumps(body)):
                return at
            self._manifests = before[:]  # another writer took the number: look again
        raise StoreError("could not commit: too many concurrent writers", "40001")

    def begin(self) -> Transaction:
        return Transaction(self)

    def _auto(self, f) -> int:
        txn = self.begin()
        n = f(txn)
        txn.commit()
        return n

    def insert(self, name: str, rows: DataFrame) -> int:
        return self._auto(lambda t: t.insert(name, rows))

    def update(self, name: str, changes: dict[str, Column], where: Column | None = None, key=None, valid=None) -> int:
        return self._auto(lambda t: t.update(name, changes, where, key, valid))

    def delete(self, name: str, where: Column | None = None, key=None) -> int:
        return self._auto(lambda t: t.delete(name, where, key))

    def merge(self, name: str, source: DataFrame, on: str, matched: dict | None = None, unmatched: dict | None = None) -> int:
        return self._auto(lambda t: t.merge(name, source, on, matched, unmatched))

    def copy_rows(self, name: str, path: str, names: list[str] | None = None, **options) -> DataFrame:
        """The rows of a text or CSV file that holds the columns `names` in that order: format csv|text, delimiter, null, quote,
        escape, header. Columns not named are null."""
        d = self.resolve(name)
        kinds = dict(d.columns)
        names = names or list(kinds)
        if len(set(names)) < len(names) or not set(names) <= set(kinds):
            raise StoreError(f"not columns of {name}, each once: {names}", "42703")
        csv = options.get("format", "text").lower() == "csv"
        given = {
            "sep": options.get("delimiter", "," if csv else "\t"), "nullValue": options.get("null", "" if csv else "\\N"), "mode": "FAILFAST",
            "header": str(bool(options.get("header", False))).lower(), "quote": options.get("quote", '"') if csv else "", "escape": options.get("escape", options.get("quote", '"')) if csv else "\\",
        }
        rows = self.spark.read.schema(", ".join(f"`{c}` {kinds[c]}" for c in names)).options(**given).csv(path)
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in names})

    def copy_from(self, name: str, path: str, names: list[str] | None = None, **options) -> int:
        """Insert copy_rows(), all or none."""
        return self.insert(name, self.copy_rows(name, path, names, **options))

    # --- introspection ---

    def commits(self) -> DataFrame:
        """(seq, txn, at, principal, prev, hash, linked): each commit's record, recomputed and held against the next."""
        rows = [(m["seq"], m["txn"], m["at"], m["principal"], m["prev"], m["hash"]) for m in self.manifests()]
        log = self.spark.createDataFrame(rows, "seq bigint, txn bigint, at bigint, principal string, prev string, hash string")
        wide = lambda c: F.lpad(F.hex(c), 16, "0")
        own = F.sha2(F.unhex(F.concat(wide("txn"), wide("at"), wide("seq"), F.col("prev"))), 256)
        before = F.coalesce(F.lag("hash").over(W.orderBy("seq")), F.lit(GENESIS))
        return log.withColumn("linked", (own == F.col("hash")) & (before == F.col("prev")))

    def verify_chain(self, head: str | None = None) -> tuple[bool, int, str]:
        """(intact, length, head hash); `head` is a hash noted earlier that the chain must still hold."""
        log = self.commits()
        bad = log.where("NOT linked").limit(1).count()
        ms = self.manifests()
        known = head is None or any(m["hash"] == head for m in ms)
        return (not bad and known, len(ms), ms[-1]["hash"] if ms else GENESIS)

    def audit(self, name: str, key=None) -> DataFrame:
        """Every version with its commit's hash, the one before it, and whether the chain holds there."""
        rows = timeline.history(self.history(name), key)
        return rows.join(self.commits().select(F.col("txn").alias("_prov_txn_id"), "hash", "prev", "linked"), "_prov_txn_id", "left")

    def segments(self, name: str) -> DataFrame:
        """(segment, state, rows, sys_min, sys_max, key_column, key_min, key_max, bytes): one row a version file."""
        h = self.history(name)

        def of(log: DataFrame, state: str) -> DataFrame:
            return log.groupBy(F.col("_metadata.file_path").alias("segment"), F.lit(state).alias("state")).agg(
                F.count(F.lit(1)).alias("rows"), F.min("sys_from").alias("sys_min"), F.max("sys_from").alias("sys_max"), F.lit(h.key).alias("key_column"),
                F.min(h.key).cast("string").alias("key_min"), F.max(h.key).cast("string").alias("key_max"), F.max("_metadata.file_size").alias("bytes"),
            )

        parts = [of(h.versions, "open")] if self._folders(name, "versions") else []
        parts += [of(h.sealed, "sealed")] if h.sealed is not None else []
        none = "segment string, state string, rows bigint, sys_min bigint, sys_max bigint, key_column string, key_min string, key_max string, bytes bigint"
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else self.spark.createDataFrame([], none)

    def compact(self, name: str) -> int:
        """Rewrite a table's logs as fewer files in key and time order, versions whose end is known sealed with it: later reads
        filter those on both bounds. No version is lost; old folders stay for backups."""
        seen = len(self.manifests())
        d, h, tag = self.resolve(name), self.history(name), uuid.uuid4().hex
        folders = {k: f"data/{name}/{tag}/{k}" for k in ("versions", "retractions", "sealed")}
        whole = timeline.endpoints(h, degenerate=True).cache()
        closed = F.col("sys_to") < FOREVER
        try:
            for kind, rows, schema in (("versions", whole.where(~closed), d.version_schema()), ("sealed", whole.where(closed), d.sealed_schema())):
                rows = rows.select(*[f.name for f in schema])
                rows.repartitionByRange(d.key, "sys_from").sortWithinPartitions(d.key, "sys_from").write.parquet(f"{self.root}/{folders[kind]}")
        finally:
            whole.unpersist()
        # Every retraction closed a version, which is sealed now.
        self.spark.createDataFrame([], d.retraction_schema()).write.parquet(f"{self.root}/{folders['retractions']}")
        data = {k: {name: [v]} for k, v in folders.items()}
        return self._commit(replaces={name: dict.fromkeys(folders, True)}, data=data, seen=seen)

    def backup(self, target: str) -> None:
        """Copy data, then manifests: what a copied manifest names is there. `_sums` holds every file's length and SHA-256."""
        target = target.rstrip("/")
        for part in ("data", "_commits"):
            if self.files.exists(f"{self.root}/{part}"):
                self.files.copy(f"{self.root}/{part}", f"{target}/{part}")
        _sums(self.spark, target).write.parquet(f"{target}/_sums")

    @classmethod
    def restore(cls, spark: SparkSession, source: str, root: str, **options) -> Store:
        """A store at `root` from a backup, once every file of it is as its sums say."""
        source = source.rstrip("/")
        now, then = _sums(spark, source), spark.read.parquet(f"{source}/_sums")
        if now.exceptAll(then).unionByName(then.exceptAll(now)).limit(1).count():
            raise StoreError("the backup does not hold what its sums say", "XX001")
        files = Files(spark)
        if files.exists(f"{root.rstrip('/')}/_commits"):
            raise StoreError("there is a store already", "42P07")
        for part in ("data", "_commits"):
            if files.exists(f"{source}/{part}"):
                files.copy(f"{source}/{part}", f"{root.rstrip('/')}/{part}")
        return cls(spark, root, **options)


def _sums(spark: SparkSession, root: str) -> DataFrame:
    """(file, length, sha256) of the files of a backup, by their place in it."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*")
    parts = [f"{root}/{p}" for p in ("data", "_commits") if Files(spark).exists(f"{root}/{p}")]
    file = F.regexp_extract("path", "/((?:data|_commits)/[^/].*)$", 1)
    return read.load(parts).select(file.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


class Transaction:
    """A snapshot and the writes staged on it. Reads see them; commit checks that no one else wrote the same keys."""

    def __init__(self, store: Store):
        self.store = store
        self.anchor = store.now()
        self.seen = len(store.manifests())
        self.number = self.seen + 1  # shown by reads before the commit, which settles it
        self.batch: str | None = None
        self.staged: list[tuple[str, str, DataFrame]] = []
        self.marks: dict[str, int] = {}

    def savepoint(self, name: str) -> None:
        self.marks[name] = len(self.staged)

    def rollback_to(self, name: str) -> None:
        if name not in self.marks:
            raise StoreError(f"no such savepoint: {name}", "3B001")
        self._drop(self.marks[name])

    def release(self, name: str) -> None:
        self.marks.pop(name, None)

    def rollback(self) -> None:
        self._drop(0)

    def _drop(self, first: int) -> None:
        for _, _, df in self.staged[first:]:
            df.unpersist()
        del self.staged[first:]

    def history(self, name: str) -> History:
        """The snapshot with this transaction's writes on top, at the instant after it."""
        h = self.store.history(name, self.anchor)
        for i, (table, kind, df) in enumerate(self.staged):
            if table != name:
                continue
            if kind == "version":
                own = df.withColumns({"sys_from": F.lit(self.anchor + 1), "seq": F.lit((1 << 62) + i), "_prov_txn_id": F.lit(self.number).cast("long"), "_prov_committed_at": F.lit(self.anchor + 1), "_prov_principal": F.lit(self.store.principal)})
                h = h.with_logs(h.versions.unionByName(own, allowMissingColumns=True), h.retractions)
            else:
                own = df.withColumns({"closed_at": F.lit(self.anchor + 1), "_prov_txn_id": F.lit(self.number).cast("long"), "_prov_principal": F.lit(self.store.principal)})
                h = h.with_logs(h.versions, h.retractions.unionByName(own, allowMissingColumns=True))
        return h

    def read(self, name: str, valid_at: int | None = None, at: int | None = None) -> DataFrame:
        return timeline.as_of(self.history(name), self.anchor + 1 if at is None else at, valid_at)

    def _current(self, name: str) -> DataFrame:
        """Live versions with the names of their logs' columns."""
        h = self.history(name)
        latest = h.versions.where(F.col("sys_from") <= self.anchor + 1).groupBy(h.key).agg(
            F.max_by(F.struct("sys_from", "seq", *[c for c in h.carried() if not c.startswith("_prov")]), F.struct("sys_from", "seq")).alias("_v")
        ).select(h.key, "_v.*")
        closed = h.retractions.where(F.col("closed_at") <= self.anchor + 1).select(h.key, "sys_from", "seq")
        return latest.join(closed, [h.key, "sys_from", "seq"], "left_anti")

    def _stage(self, name: str, kind: str, df: DataFrame) -> int:
        df = df.cache()
        n = df.count()
        if n:
            self.staged.append((name, kind, df))
        return n

    def _periods(self, d: TableDef, rows: DataFrame) -> DataFrame:
        """Valid-time columns as valid_from and valid_to in microseconds; each row must have a sound period."""
        if not d.valid:
            return rows

        def us(c: str) -> Column:
            kind = dict(rows.dtypes)[c]
            return F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c).cast("long")

        start, end = d.valid
        if start not in rows.columns:
            raise StoreError("a write to a valid-time table must carry its period", "23502")
        rows = rows.withColumn("valid_from", us(start)).withColumn("valid_to", F.coalesce(us(end), F.lit(FOREVER)) if end in rows.columns else F.lit(FOREVER))
        if rows.where("valid_from IS NULL OR valid_from >= valid_to").limit(1).count():
            raise StoreError("a period is empty, reversed or without a start", "22000")
        return rows.drop(*d.valid)

    def _typed(self, d: TableDef, rows: DataFrame) -> DataFrame:
        kinds = dict(d.columns)
        period = ["valid_from", "valid_to"] if d.valid else []
        if missing := [c for c in d.payload if c not in rows.columns]:
            raise StoreError(f"every column must be supplied; missing: {missing}", "23502")
        return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in d.payload], *period)

    def insert(self, name: str, rows: DataFrame) -> int:
        d = self.store.resolve(name)
        new = self._typed(d, self._periods(d, rows))
        if new.where(F.col(d.key).isNull()).limit(1).count():
            raise StoreError("null business key", "23502")
        if new.groupBy(d.key).count().where("count > 1").limit(1).count() or new.join(self._current(name), d.key, "left_semi").limit(1).count():
            raise StoreError("key exists", "23505")
        return self._stage(name, "version", new)

    def update(self, name: str, changes: dict[str, Column], where: Column | None = None, key=None, valid=None) -> int:
        """valid: (from, to) microseconds or columns of the new versions; a valid-time table needs it. The key does not change."""
        d = self.store.resolve(name)
        if d.key in changes:
            raise StoreError("the business key cannot be updated", "42601")
        if bool(d.valid) != (valid is not None):
            raise StoreError("a write carries a period exactly if the table has a valid axis", "23502")
        rows = self._current(name)
        rows = rows.where(F.col(d.key) == F.lit(key)) if key is not None else rows if where is None else rows.where(where)
        rows = rows.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in changes.items()})
        if valid is not None:
            start, end = valid
            col = lambda x: x if isinstance(x, Column) else F.lit(x)
            rows = rows.withColumns({"valid_from": col(start).cast("long"), "valid_to": F.coalesce(col(end).cast("long"), F.lit(FOREVER))})
            if rows.where("valid_from IS NULL OR valid_from >= valid_to").limit(1).count():
                raise StoreError("a period is empty, reversed or without a start", "22000")
        n = self._stage(name, "version", self._typed(d, rows))
        if key is not None and not n:
            raise StoreError(f"no such key: {key}", "02000")
        return n

    def delete(self, name: str, where: Column | None = None, key=None) -> int:
        d = self.store.resolve(name)
        rows = self._current(name)
        rows = rows.where(F.col(d.key) == F.lit(key)) if key is not None else rows if where is None else rows.where(where)
        n = self._stage(name, "retraction", rows.select(d.key, "sys_from", "seq"))
        if key is not None and not n:
            raise StoreError(f"no such key: {key}", "02000")
        return n

    def merge(self, name: str, source: DataFrame, on: str, matched: dict | None = None, unmatched: dict | None = None) -> int:
        """source rows probe the target's key by source column `on`. matched/unmatched: target column -> source column,
        Column over the source, or value; valid-time columns among them. Either may be None: such rows are skipped."""
        d = self.store.resolve(name)
        if matched and d.key in matched:
            raise StoreError("the business key cannot be updated", "42601")
        s = source.select(F.struct(*source.columns).alias("_s")).withColumn("_k", F.col(f"_s.{on}").cast(dict(d.columns)[d.key]))

        def value(v) -> Column:
            if isinstance(v, str) and v in source.columns:
                return F.col(f"_s.{v}")
            return v if isinstance(v, Column) else F.lit(v)

        live = self._current(name).select(F.struct("*").alias("_t"), F.col(d.key).alias("_tk"))
        both = s.join(live, s["_k"] == live["_tk"], "left").cache()
        try:
            return self._merged(name, d, source, both, live, value, matched, unmatched)
        finally:
            both.unpersist()

    def _merged(self, name: str, d: TableDef, source: DataFrame, both: DataFrame, live: DataFrame, value, matched: dict | None, unmatched: dict | None) -> int:
        acting = F.col("_tk").isNotNull() if unmatched is None else F.lit(True) if matched is not None else F.col("_tk").isNull()
        target = F.coalesce("_tk", value(unmatched[d.key]).cast(dict(d.columns)[d.key])) if unmatched else F.col("_tk")
        acted = both.where(acting).withColumn("_key", target)
        if acted.where("_key IS NULL").limit(1).count():
            raise StoreError("null business key", "23502")
        if acted.groupBy("_key").count().where("count > 1").limit(1).count():
            raise StoreError("two source rows meet one target row", "21000")
        if unmatched:
            fresh = acted.where("_tk IS NULL").join(live.select(F.col("_tk").alias("_key")), "_key", "left_semi")
            if fresh.limit(1).count():
                raise StoreError("key exists", "23505")
        lots = []
        if matched is not None:
            own = [(value(matched[c]) if c in matched else F.col(f"_t.{c}")).alias(c) for c in d.payload]
            lots.append(acted.where("_tk IS NOT NULL").select(*own, *self._bounds(d, matched, value)))
        if unmatched is not None:
            own = [(value(unmatched[c]) if c in unmatched else F.lit(None)).alias(c) for c in d.payload]
            lots.append(acted.where("_tk IS NULL").select(*own, *self._bounds(d, unmatched, value)))
        rows = [self._typed(d, self._periods(d, lot)) for lot in lots]
        return self._stage(name, "version", rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]))

    @staticmethod
    def _bounds(d: TableDef, arm: dict, value) -> list[Column]:
        return [value(arm[c]).alias(c) for c in d.valid or () if c in arm]

    def check(self) -> None:
        """First committer wins: no commit since the snapshot may have written a key that this one writes."""
        later = self.store.manifests()[self.seen :]
        for name in {t for t, _, _ in self.staged}:
            d = self.store.resolve(name, self.anchor)
            if any(x["name"] == name for m in later for x in m.get("ddl", [])):
                raise StoreError(f"the table changed since the snapshot: {name}", "40001")
            paths = [f"{self.store.root}/{p}" for m in later if "replaces" not in m for k in ("versions", "retractions") for p in m.get(k, {}).get(name, [])]
            for p in paths:
                theirs = self.store.spark.read.parquet(p).select(d.key)
                for table, _, df in self.staged:
                    if table == name and df.join(theirs, d.key, "left_semi").limit(1).count():
                        raise StoreError("could not serialise: a concurrent commit wrote the same key", "40001")

    def write(self, at: int, seq: int) -> dict:
        """Data files of the staged writes, stamped with the commit; called once the commit's number is settled."""
        out: dict = {"versions": {}, "retractions": {}}
        stamp = {"_prov_txn_id": F.lit(seq).cast("long"), "_prov_principal": F.lit(self.store.principal)}
        tag = uuid.uuid4().hex
        for i, (name, kind, df) in enumerate(self.staged):
            d = self.store.resolve(name)
            path = f"data/{name}/{seq:012d}-{tag}-{i}/{kind}s"
            if kind == "version":
                order = seq * 1_000_000 + i
                full = df.withColumns(stamp | {"sys_from": F.lit(at), "seq": F.lit(order).cast("long"), "_prov_committed_at": F.lit(at)})
                full.select(*[f.name for f in d.version_schema()]).write.parquet(f"{self.store.root}/{path}")
            else:
                # A version staged by this very transaction is closed in its own tick.
                own = F.col("seq") >= F.lit(1 << 62)
                moved = df.withColumns({"sys_from": F.when(own, F.lit(at)).otherwise(F.col("sys_from")), "seq": F.when(own, F.lit(seq * 1_000_000) + (F.col("seq") - F.lit(1 << 62))).otherwise(F.col("seq"))})
                full = moved.withColumns(stamp | {"closed_at": F.lit(at)})
                full.select(*[f.name for f in d.retraction_schema()]).write.parquet(f"{self.store.root}/{path}")
            out[f"{kind}s"].setdefault(name, []).append(path)
        return out

    def commit(self) -> int | None:
        if not self.staged:
            return None
        at = self.store._commit(self)
        self._drop(0)
        return at
