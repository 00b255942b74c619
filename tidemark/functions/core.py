"""Column functions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that stand for "no value" in key columns, compared in lower case.
FILLER_WORDS = ("", "unknown", "na", "n/a", "none", "null", "nil", "-", "test", "dummy", "undefined")


def fresh(df: DataFrame, base: str, also: Iterable[str] = ()) -> str:
    """A column name that clashes with none of ``df``'s, whatever the case."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in also}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def q(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def canonical_id(c: Column) -> Column:
    """A UUID in lower case with hyphens, however it is spelled.

    Braces, brackets, white space, a ``urn:uuid:`` prefix, upper case and missing hyphens are
    accepted. Other identifiers come out trimmed, in lower case; blank ones are null.
    """
    bare = F.regexp_replace(F.lower(c), r"urn:uuid:|[^0-9a-z]", "")
    dashed = F.concat_ws(
        "-",
        F.substring(bare, 1, 8),
        F.substring(bare, 9, 4),
        F.substring(bare, 13, 4),
        F.substring(bare, 17, 4),
        F.substring(bare, 21, 12),
    )
    plain = F.lower(F.trim(c))
    # Nearly all identifiers are canonical already; one cheap match spares them the rest.
    return (
        F.when(c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), c)
        .when(bare.rlike("^[0-9a-f]{32}$"), dashed)
        .when(F.length(plain) > 0, plain)
    )


def pack_id(c: Column) -> Column:
    """A canonical identifier as binary: a UUID in 16 bytes, any other text after 17 zero bytes, and
    nothing for null. Half as long to shuffle, and still one value for each identifier."""
    uuid = c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    text = F.concat(F.unhex(F.lit("00" * 17)), F.encode(c, "utf-8"))
    return F.coalesce(F.when(uuid, F.unhex(F.replace(c, F.lit("-"), F.lit("")))).otherwise(text), F.unhex(F.lit("")))


def unpack_id(c: Column) -> Column:
    """The identifier that ``pack_id`` made ``c`` of."""
    h = F.lower(F.hex(c))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(F.length(c) == 16, dashed).when(F.length(c) > 17, F.decode(F.substring(c, 18, 2**30), "utf-8"))


def instant(c: Column) -> Column:
    """An ISO-8601 text with an offset, as a timestamp; null where it cannot be read.

    A column that is a timestamp already passes.
    """
    return c.try_cast("timestamp")


def is_filler(c: Column) -> Column:
    """True for null, blank, a filler word, or nothing but zeros and separators."""
    word = F.lower(F.trim(c))
    return c.isNull() | word.isin(*FILLER_WORDS) | word.rlike("^[0._-]+$")


def present(c: Column) -> Column:
    """Not null and not blank."""
    return c.isNotNull() & (F.trim(c) != "")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def utc_day(c: Column) -> Column:
    return F.to_date(c)


def clean_response(c: Column) -> Column:
    """A network response without case, separators or an added cause code; null for a blank one."""
    bare = F.regexp_replace(F.lower(c), r"\s*(\(\s*\d+\s*\)|[/:#-]\s*\d+)\s*$", "")
    word = F.regexp_replace(bare, r"[^a-z0-9]", "")
    return F.when(F.length(word) > 0, word)


def plausible(c: Column, lo: float, hi: float) -> Column:
    """``c`` where it lies in [lo, hi], else null."""
    return F.when((c >= lo) & (c <= hi), c)
