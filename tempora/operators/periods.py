"""Half-open periods: the seven predicates, row periods, and constant instants."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeline import TemporalError

#: Predicate name -> relation over (a.from, a.to, b.from, b.to).
PREDICATES = {
    "CONTAINS": lambda af, at, bf, bt: (af <= bf) & (bt <= at),
    "OVERLAPS": lambda af, at, bf, bt: (af < bt) & (bf < at),
    "EQUALS": lambda af, at, bf, bt: (af == bf) & (at == bt),
    "PRECEDES": lambda af, at, bf, bt: at <= bf,
    "SUCCEEDS": lambda af, at, bf, bt: bt <= af,
    "IMMEDIATELY PRECEDES": lambda af, at, bf, bt: at == bf,
    "MEETS": lambda af, at, bf, bt: at == bf,
    "IMMEDIATELY SUCCEEDS": lambda af, at, bf, bt: af == bt,
}
#: Microseconds of the units an interval may use; months and years have no fixed length.
UNITS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def period(start, end) -> tuple[Column, Column, bool]:
    """A period of two instants (ints) or columns; constant ones must not be empty."""
    constant = isinstance(start, int) and isinstance(end, int)
    if constant and start >= end:
        raise TemporalError(f"empty period: {start} to {end}")
    col = lambda x: F.lit(x) if isinstance(x, int) else x if isinstance(x, Column) else F.col(x)
    return col(start), col(end), constant


def compare(a: tuple, predicate: str, b: tuple) -> Column:
    """A period predicate as a condition; a row period that is null, empty or reversed makes it null."""
    relation = PREDICATES.get(" ".join(predicate.upper().split()))
    if relation is None:
        raise TemporalError(f"unknown period predicate: {predicate}")
    (af, at, ac), (bf, bt, bc) = period(*a), period(*b)
    truth = relation(af, at, bf, bt)
    sound = [f < t for f, t, constant in ((af, at, ac), (bf, bt, bc)) if not constant]
    for s in sound:
        truth = F.when(s, truth)
    return truth


def period_sql(a: tuple, predicate: str, b: tuple) -> str:
    """compare() as SQL text; bounds are instants (ints) or the text of columns, which may be timestamps."""
    for start, end in (a, b):
        period(start if isinstance(start, int) else "x", end if isinstance(end, int) else "x")
    relation = {
        "CONTAINS": "{0} <= {2} AND {3} <= {1}", "OVERLAPS": "{0} < {3} AND {2} < {1}", "EQUALS": "{0} = {2} AND {1} = {3}", "PRECEDES": "{1} <= {2}",
        "SUCCEEDS": "{3} <= {0}", "IMMEDIATELY PRECEDES": "{1} = {2}", "MEETS": "{1} = {2}", "IMMEDIATELY SUCCEEDS": "{0} = {3}",
    }[predicate]
    stamped = lambda x: f"{x}L" if x >= 0 else f"(-{-x}L)"
    bounds = [stamped(x) if isinstance(x, int) else x for x in (*a, *b)]
    sound = [f"{s} < {e}" for s, e, p in ((bounds[0], bounds[1], a), (bounds[2], bounds[3], b)) if not all(isinstance(x, int) for x in p)]
    truth = relation.format(*bounds)
    return f"(CASE WHEN {' AND '.join(sound)} THEN {truth} END)" if sound else f"({truth})"


def interval_us(text: str) -> int:
    """Microseconds of "n unit [n unit ...]"."""
    parts = re.findall(r"([+-]?\d+)\s*([A-Za-z]+)", text)
    if not parts or re.sub(r"([+-]?\d+)\s*([A-Za-z]+)|\s|,", "", text):
        raise TemporalError(f"not an interval: {text}")
    total = 0
    for n, unit in parts:
        name = unit.lower().rstrip("s") or unit.lower()
        if name not in UNITS:
            raise TemporalError(f"interval unit without a fixed length: {unit}")
        total += int(n) * UNITS[name]
    return total


def instant(expression: str, now: int) -> int:
    """now(), now() +/- interval '...', or integer microseconds, folded with one `now` a statement."""
    text = expression.strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    m = re.fullmatch(r"now\s*\(\s*\)(?:\s*([+-])\s*interval\s*'([^']*)')?", text, re.I)
    if not m:
        raise TemporalError(f"not an instant: {expression}")
    return now if not m[1] else now + (1 if m[1] == "+" else -1) * interval_us(m[2])
