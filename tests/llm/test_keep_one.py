"""What stays where rows share a doc_id or have none."""

import pytest

from tempora.llm import shingles, simhash


@pytest.mark.parametrize("keep_one", [simhash.keep_one, shingles.keep_one])
def test_rows_are_kept_not_ids(spark, keep_one):
    text = {c: " ".join(f"{c}{i * i % 101}" for i in range(60)) for c in "abcdef"}
    data = [(5, text["a"]), (5, text["b"]), (5, text["c"]), (3, text["b"]), (7, text["c"]), (None, text["d"]), (None, text["d"]), (None, text["e"]), (9, text["e"]), (None, text["f"])]
    got = keep_one(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    want = [(5, "a"), (3, "b"), (5, "c"), (None, "d"), (9, "e"), (None, "f")]
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), text[c]) for i, c in want)
