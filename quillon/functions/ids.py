"""Identifiers: 16 bytes, made from text, numbers or hashes, and shown as text or hex."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_BYTES = 16
_PRIME, _MASK = 0x01000193, (1 << 64) - 1
#: The two offsets of the attribute hash; fixed values of the wire format.
_OFFSETS = (0xCBF29CE484222325, 0x84222325CBF29CE4)


def id_from_text(text: str) -> bytes:
    """The first 16 bytes of the UTF-8 text, padded with zeros."""
    return text.encode()[:ID_BYTES].ljust(ID_BYTES, b"\0")


def id_from_number(n: int) -> bytes:
    return n.to_bytes(8, "little").ljust(ID_BYTES, b"\0")


def random_id() -> str:
    return os.urandom(ID_BYTES).hex()


def attribute_id(name: str, entity: str | None = None) -> bytes:
    """Two 64-bit multiply-after-xor hashes over "Entity/field", each little-endian.

    32 hex digits, with or without 0x, are taken as they are; a bare field belongs to the given entity.
    """
    plain = name.removeprefix("0x")
    if len(plain) == 2 * ID_BYTES and all(c in "0123456789abcdefABCDEF" for c in plain):
        return bytes.fromhex(plain)
    if "/" not in name:
        if not entity:
            raise ValueError(f"the field {name!r} needs an entity")
        name = f"{entity}/{name}"
    parts = []
    for h in _OFFSETS:
        for byte in name.encode():
            h = ((h ^ byte) * _PRIME) & _MASK
        parts.append(h.to_bytes(8, "little"))
    return b"".join(parts)


def id_column(text: Column) -> Column:
    """id_from_text for a column."""
    return F.rpad(F.substring(F.encode(text, "UTF-8"), 1, ID_BYTES), ID_BYTES, F.unhex(F.lit("00")))


def show_id(raw: Column) -> Column:
    """Text without trailing zero bytes if it is UTF-8, else lower-case hex."""
    trimmed = F.regexp_replace(F.hex(raw), "(00)+$", "")
    trimmed = F.when(F.length(trimmed) % 2 == 1, F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    return F.coalesce(F.try_validate_utf8(F.unhex(trimmed).cast("string")), F.lower(F.hex(raw)))


def show_datom(kind: Column, s: Column, n: Column, b: Column) -> Column:
    """Display: #id for entities and references, :field for fields, quoted strings, plain numbers and booleans."""
    return (
        F.when(kind.isin("entity", "ref"), F.concat(F.lit("#"), s))
        .when(kind == "field", F.concat(F.lit(":"), s))
        .when(kind == "str", F.concat(F.lit('"'), s, F.lit('"')))
        .when(kind == "num", n.cast("string"))
        .when(kind == "bool", b.cast("string"))
        .when(kind == "null", F.lit("null"))
    )
