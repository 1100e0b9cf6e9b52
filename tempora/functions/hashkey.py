"""Portable hash keys: SHA-256 over a framed list of typed values, equal in every language that frames them so.

Message: magic (6 bytes), number of arguments (u32), and for each argument its type tag (u8), its body's length (u64)
and its body; integers are big-endian. The magic is a parameter: keys of one magic never meet those of another.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic and type tags of the format, version 1.
MAGIC = b"STLHK1"
TAGS = {
    "null": 0, "bool": 1, "int4": 2, "int8": 3, "text": 4, "timestamp": 5, "date": 6, "timestamptz": 7, "period": 8, "uuid": 9, "bytea": 10,
}


def _be(value: Column, size: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size)))


def _body(kind: str, value) -> Column:
    if kind == "bool":
        return F.when(value, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    if kind in ("int4", "date"):
        number = F.datediff(value, F.lit("1970-01-01").cast("date")) if kind == "date" else value
        return _be(number, 4)
    if kind in ("int8", "timestamp", "timestamptz"):
        return _be(value, 8)
    if kind == "text":
        return F.encode(value, "UTF-8")
    if kind == "period":
        return F.concat(_be(value["from"], 8), _be(value["to"], 8))
    if kind == "uuid":
        return F.unhex(F.regexp_replace(value, "-", ""))
    return value


def hash_key(*args: tuple[str, Column | None], magic: bytes = MAGIC) -> Column:
    """args: (type name, column); instants are microseconds, uuids canonical text. Lower-case hex; works row by row."""
    parts = [F.unhex(F.lit(magic.hex())), F.unhex(F.lit(f"{len(args):08x}"))]
    null = F.unhex(F.lit("00" * 9))
    for kind, value in args:
        if value is None or kind == "null":
            parts.append(null)
            continue
        body = _body(kind, value)
        framed = F.concat(F.unhex(F.lit(f"{TAGS[kind]:02x}")), _be(F.octet_length(body), 8), body)
        parts.append(F.when(value.isNull(), null).otherwise(framed))
    return F.sha2(F.concat(*parts), 256)


def constant_key(*values, magic: bytes = MAGIC) -> str:
    """The key of constants: None, bool, int (int4 where it fits, else int8) or str."""
    message = magic + struct.pack(">I", len(values))
    for v in values:
        if v is None:
            kind, body = "null", b""
        elif isinstance(v, bool):
            kind, body = "bool", bytes([v])
        elif isinstance(v, int):
            kind, body = ("int4", struct.pack(">i", v)) if -(1 << 31) <= v < 1 << 31 else ("int8", struct.pack(">q", v))
        else:
            kind, body = "text", v.encode()
        message += struct.pack(">BQ", TAGS[kind], len(body)) + body
    return hashlib.sha256(message).hexdigest()
