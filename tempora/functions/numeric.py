"""Integer arithmetic in which overflow and division by zero give null and a result keeps its operands' width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = {"int": -(1 << 31), "bigint": -(1 << 63)}
CASTS = {"int": "int", "bigint": "long"}


#: Types in which the exact result of two operands of a width is sure to fit.
EXACT = {"int": "bigint", "bigint": "decimal(19,0)"}
MOST = {w: -1 - low for w, low in LEAST.items()}


def _checked(name: str, a: Column, b: Column) -> Column:
    """try_add and the like, asked only where the result fits: inside them an overflow is an exception, raised and caught, which
    costs many times the sum. Operands are evaluated more than once."""
    result = F.call_function(f"try_{name}", a, b)
    over = F.lit(False)
    for width, wide in EXACT.items():
        x, y = a.cast(wide), b.cast(wide)
        exact = {"add": x + y, "subtract": x - y, "multiply": x * y}[name]
        over = F.when(F.typeof(result) == width, ~exact.between(LEAST[width], MOST[width])).otherwise(over)
    return F.when(over, None).otherwise(result)


def add(a: Column, b: Column) -> Column:
    return _checked("add", a, b)


def subtract(a: Column, b: Column) -> Column:
    return _checked("subtract", a, b)


def multiply(a: Column, b: Column) -> Column:
    return _checked("multiply", a, b)


def divide(a: Column, b: Column, width: str = "bigint") -> Column:
    """Truncating division; the least integer over -1 does not fit and is null."""
    overflow = (a == F.lit(LEAST[width])) & (b == -1)
    wide = F.call_function("div", a.cast("long"), b.cast("long"))
    return F.when((b != 0) & ~overflow, wide.cast(CASTS[width]))


def modulo(a: Column, b: Column) -> Column:
    """The remainder, with the dividend's sign."""
    return F.when(b == -1, F.lit(0).cast("int") * a).otherwise(F.try_mod(a, b))
