"""Substring dedup by hashing units of text: normalise, group digests over the whole corpus, keep the earliest
occurrence, remove the rest, keep original offsets.

Units are lines, cut within where the words themselves say so: a line is cut after a word whose hash, with that of the
word before it, is the strict minimum among the `close` words around it, and the end of a sentence counts as less than
any hash. A cut depends on those words only, never on what precedes, so two documents that share a passage are cut alike
inside it, wherever it begins and whether or not it holds marks. Cuts keep `close`/2 words from each other and from a
line's ends; where words repeat so that no minimum exists, a line is cut every `LONGEST` words. Letters of scripts written
without blanks count as half a word each. Units under `least` words (headings, single words) are never removed. What a
shared passage holds before its first cut and after its last stays. A digest is 128 bits of the unit's lower-cased words
joined by single spaces.

The earliest occurrence is that of the smallest (doc_id, row, start), null ids last. Digests are counted with map-side
sums; only digests that occur more than once are joined back, and that join is one Spark can split when a digest is
hot. Offsets are code points, end exclusive.

Edge cases: null and empty texts have no units; repeated rows are told apart by a row number written once; every row
returns one row, removed or not; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, unused

CLOSE, LEAST = 8, 5
#: Words of a run of repeated units that goes.
RUN = 20
#: Words after which a line without any other cut is cut.
LONGEST = 32
#: Words read at once.
BLOCK = 1 << 15
#: Letters of scripts that part no words by blanks: Thai to Tibetan, Burmese, Khmer, kana, Han, Yi, and their marks.
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3001-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\uf900-\ufaff\uff01-\uff0f\uff1a-\uff1f\uff61-\uff9f\U00020000-\U0003ffff"
WORD = re.compile(rf"[{_DENSE}]|[^\s{_DENSE}]+")
DENSE = re.compile(f"[{_DENSE}]")
STOPS = frozenset(".!?\u3002\uff01\uff1f\uff61")
UNIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _cuts(hashes: np.ndarray, dense: np.ndarray, stops: np.ndarray, opens: np.ndarray, reach: int) -> np.ndarray:
    """Whether each word is a line's last or a cut falls after it. A word takes two slots, a dense letter one."""
    before = np.where(opens, 0, np.concatenate([hashes[:1], hashes[:-1]]))
    keys = ((hashes * np.uint64(0x9E3779B97F4A7C15) + before) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(2)
    keys = np.where(stops, keys, keys | np.uint64(1 << 62)) | np.uint64(1)
    last = np.concatenate([opens[1:], [True]])
    keys[last] = 0
    at = np.cumsum(np.where(dense, 1, 2)) - 1 + 2 * reach
    most = np.iinfo(np.uint64).max
    slots = np.full(at[-1] + 1 + 2 * reach, most, np.uint64)
    slots[at] = keys
    if opens[0]:
        slots[2 * reach - 1] = 0
    around = np.full(len(keys), most, np.uint64)
    for d in range(1, 2 * reach + 1):
        np.minimum(around, np.minimum(slots[at - d], slots[at + d]), out=around)
    return last | (keys < around)


def units(text: str | None, close: int = CLOSE, least: int = LEAST) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit of at least `least` words."""
    if not text:
        return
    reach = max(1, close // 2)
    context = 4 * reach + 2  # words a cut can depend on, on one side, dense letters and the pair's first included
    found = WORD.finditer(text)
    words: list[tuple[int, int, str, bool]] = []  # start, end, lower-cased, first of its line
    begin, fresh, end = 0, True, 0
    while fresh:
        more = [(m.start(), m.end(), m.group()) for m in islice(found, BLOCK)]
        fresh = len(more) == BLOCK
        for a, b, word in more:
            words.append((a, b, word.lower(), not end or text.find("\n", end, a) >= 0))
            end = b
        if not words:
            return
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w[2]) for w in words), np.uint64, len(words))
        dense = np.fromiter((DENSE.match(w[2]) is not None for w in words), bool, len(words))
        stops = np.fromiter((w[2][-1] in STOPS for w in words), bool, len(words))
        opens = np.fromiter((w[3] for w in words), bool, len(words))
        size = np.where(dense, 1, 2)
        sure = len(words) - context if fresh else len(words)
        ends = np.flatnonzero(_cuts(hashes, dense, stops, opens, reach)[: max(0, sure)]).tolist()
        for e in [*ends, None]:
            stop = sure if e is None else e + 1
            while begin < stop:
                forced = stop - begin >= LONGEST + least
                if e is None and not forced:
                    break
                till = begin + LONGEST if forced else stop
                held_size = int(size[begin:till].sum())
                if held_size >= 2 * least:
                    held = " ".join([w[2] for w in words[begin:till]])
                    yield words[begin][0], words[till - 1][1], held_size // 2, xxhash.xxh3_128_digest(held.encode())
                begin = till
        drop = max(0, begin - context)
        words, begin = words[drop:], begin - drop


def unit_column(close: int = CLOSE, least: int = LEAST):
    @F.arrow_udf("array<struct<start: int, end: int, words: int, h1: bigint, h2: bigint>>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            starts, ends, words, digests, offsets = [], [], [], [], [0]
            for x in texts:
                for a, b, n, d in units(x.as_py(), close, least):
                    starts.append(a)
                    ends.append(b)
                    words.append(n)
                    digests.append(d)
                offsets.append(len(starts))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            values = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, fields=list(UNIT)))

    return split


def removals(rows: DataFrame, run: int = RUN) -> DataFrame:
    """rows: (row, doc_id, units). (row, doc_id, start, end, kept_in): the occurrences that go, with the id that keeps them."""
    found = rows.select("row", "doc_id", F.size("units").alias("whole"), F.posexplode("units").alias("place", "u")).select("row", "doc_id", "whole", "place", "u.*")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "start")
    # Written, so that the join stands on shuffles of its own, which Spark can split at a hot digest.
    firsts = durable(
        found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1").select("h1", "h2", "first"),
        "firsts",
    )
    more = found.join(firsts, ["h1", "h2"]).where(rank != F.col("first")).select("row", "doc_id", "whole", "place", "start", "end", "words", F.col("first.doc_id").alias("kept_in"))
    # Written for the same reason: what follows needs a text's units together, at most one text's in a group.
    more = durable(more, "repeats").withColumn("island", F.col("place") - F.row_number().over(W.partitionBy("row").orderBy("place")))
    together = W.partitionBy("row", "island")
    held = more.withColumn("run", F.sum("words").over(together)).withColumn("all", F.count(F.lit(1)).over(together) == F.col("whole"))
    return held.where((F.col("run") >= run) | F.col("all")).select("row", "doc_id", "start", "end", "kept_in")


def _per_row(rows: DataFrame, run: int) -> DataFrame:
    return removals(rows, run).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kept_in"))).alias("removed"))


def repeated_units(docs: DataFrame, close: int = CLOSE, least: int = LEAST, run: int = RUN) -> DataFrame:
    """(doc_id, n_units, n_removed, removed_chars, removed) for each row of docs; removed: array of (start, end, kept_in)."""
    rows = durable(
        docs.select("doc_id", unit_column(close, least)("text").alias("units")).withColumn("row", F.monotonically_increasing_id()), "units"
    )
    counts = rows.select("row", "doc_id", F.size("units").alias("n_units"))
    none = F.array().cast(f"array<struct<start: int, end: int, kept_in: {docs.schema['doc_id'].dataType.simpleString()}>>")
    return (
        counts.join(_per_row(rows, run), "row", "left")
        .withColumn("removed", F.coalesce("removed", none))
        .select(
            "doc_id",
            "n_units",
            F.size("removed").alias("n_removed"),
            F.aggregate("removed", F.lit(0), lambda acc, s: acc + s["end"] - s["start"]).alias("removed_chars"),
            "removed",
        )
    )


def remove_repeats(docs: DataFrame, close: int = CLOSE, least: int = LEAST, run: int = RUN) -> DataFrame:
    """docs with repeated units cut out of text, and __removed (with more underscores if docs has such a column): the
    original offsets of what went, null where nothing did."""
    own, row, gone = unused(docs, "units"), unused(docs, "row"), unused(docs, "removed")
    rows = durable(docs.withColumn(own, unit_column(close, least)("text")).withColumn(row, F.monotonically_increasing_id()), "units")
    found = _per_row(rows.select(F.col(row).alias("row"), "doc_id", F.col(own).alias("units")), run)
    out = rows.join(found.select(F.col("row").alias(row), F.col("removed").alias(gone)), row, "left")
    # What stays lies between the spans that go: each piece is cut out once.
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s["end"]))
    starts = F.concat(F.transform(gone, lambda s: s["start"]), F.array(F.char_length("text")))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr(F.col("text"), a + 1, b - a)), "")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(*names, gone)
