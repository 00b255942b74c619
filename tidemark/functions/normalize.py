"""Normalisation and keyed hashing of contact values, as built-in expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_CHARS = 16


def normalize_phone(c: Column) -> Column:
    """Bare subscriber digits: separators, a leading plus, and 91 or 0 before ten digits removed."""
    d = F.regexp_replace(c, r"[\s\-.()]+", "")
    d = F.regexp_replace(d, r"^\+", "")
    return F.regexp_replace(d, r"^(?:91|0)(?=\d{10}$)", "")


def normalize_address(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal, composed from sha2: the key is a constant, so its pads are too."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def hash_value(c: Column, kind: str, pepper: str | None = None) -> Column:
    """The reference of a contact value: 16 hexadecimal digits of its digest; null for a blank one.

    ``kind``: phone or address (normalised first), id (as it is), hash_passthrough (already one).
    """
    kinds = {"phone": normalize_phone, "address": normalize_address, "id": lambda x: x, "hash_passthrough": lambda x: x}
    if kind not in kinds:
        raise ValueError(f"unknown kind of contact value: {kind}")
    v = kinds[kind](c.cast("string"))
    v = F.when(F.length(F.trim(v)) > 0, v)
    if kind == "hash_passthrough":
        return v
    digest = hmac_sha256(v, pepper.encode()) if pepper else F.sha2(v, 256)
    return F.when(v.isNotNull(), F.substring(digest, 1, HASH_CHARS))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based (SHA-1) UUID of ``name``; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )
