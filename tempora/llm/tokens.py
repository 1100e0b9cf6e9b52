"""Token counts with a sentencepiece model, without keeping any token.

Why a text may be split: no piece of the model (checked when it is loaded) holds a space mark after another
character, and a line feed exists only as a byte piece, so no merge ever crosses the start of a run of spaces or a line
feed. A text's count is therefore the sum over such units, and a unit's count can be remembered: corpora repeat their
words. Texts are taken in batches of about LOT characters, whatever their number: short texts together, long ones in
segments cut at the same boundaries. A batch's units not seen before are encoded in one call; a unit of more than SHORT
characters is not remembered, and what is remembered is bounded by bytes. Arrow columns hold texts and return one number each.

Edge cases: null and empty texts have 0 tokens; very long texts are counted whole, also those without any blank; every row
returns one row; ids are passed through, nulls included; columns of docs may have any names beside doc_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = re.compile("\n[^ \n]*| +[^ \n]*")
MARK = "▁"
#: Characters of a segment, of a batch, and of a unit that is remembered; bytes of units remembered by one worker.
SEGMENT = 1 << 16
LOT = 1 << 19
SHORT = 64
REMEMBERED = 48 << 20


class Counter:
    """Counts tokens of texts exactly as the model's own encode() gives them."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        newline = self.model.encode("\n", num_threads=1)
        self.splits = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and len(newline) == 2
        self.known: dict[str, int] = {}
        self.held = 0

    def _encode(self, units: list[str]) -> list[int]:
        # The model puts one space before whatever it encodes: a unit's first space, or one piece too many.
        found = self.model.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [1 if u == " " else len(ids) - (u[0] == "\n") for u, ids in zip(units, found, strict=True)]

    @staticmethod
    def _segments(text: str) -> Iterator[list[str]]:
        """A text's units, about SEGMENT characters of them at a time."""
        text = " " + text.replace(MARK, " ")
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SEGMENT:
                end = text.rfind("\n", at + 1, at + SEGMENT)
                if end < 0:
                    end = text.rfind(" ", at + 1, at + SEGMENT)
                    while end > at and text[end - 1] == " ":
                        end -= 1
                if end <= at:
                    end = UNIT.match(text, at).end()
            yield UNIT.findall(text, at, end)
            at = end

    def counts(self, texts: list[str | None]) -> list[int]:
        totals = [0] * len(texts)
        if not self.splits:
            return [len(self.model.encode(t, num_threads=1)) if t else 0 for t in texts]
        batch: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for units in self._segments(text) if text else ():
                batch.append((i, units))
                size += sum(map(len, units)) if len(units) < 64 else SEGMENT if len(text) > SEGMENT else len(text)
                if size >= LOT:
                    self._add(batch, totals)
                    batch, size = [], 0
        self._add(batch, totals)
        return totals

    def _add(self, batch: list[tuple[int, list[str]]], totals: list[int]) -> None:
        known = self.known
        fresh = list({u for _, units in batch for u in units if u not in known})
        if fresh:
            known.update(zip(fresh, self._encode(fresh), strict=True))
        for i, units in batch:
            totals[i] += sum([known[u] for u in units])
        for u in fresh:
            if len(u) > SHORT:
                del known[u]
            else:
                self.held += 120 + 2 * len(u)
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; model_path is read on the driver."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: a size that data never changes

    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(model.value)
        for texts in batches:
            yield pa.array(counter.counts(texts.to_pylist()), pa.int64())

    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        tokens("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
