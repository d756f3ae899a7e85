"""Medians, shares, splits, durations and hashes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(x: Column) -> Column:
    """The mean of the middle two; 0 of nothing. It holds the different values of a group: `scoring.medians` is for groups of any size."""
    return F.coalesce(F.percentile(x, 0.5), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def held_back(key: Column, percent: int = 20) -> Column:
    """Whether a key is in the fixed `percent` of all keys: four bytes of its SHA-256, big-endian, modulo 100."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100 < percent


def _base64(hexadecimal: Column) -> Column:
    """In one line, whatever the session says of line breaks."""
    return F.regexp_replace(F.base64(F.unhex(hexadecimal)), r"\s", "")


def integrity(content: Column) -> Column:
    """A subresource integrity string, sha512."""
    return F.concat(F.lit("sha512-"), _base64(F.sha2(content, 512)))


def content_id(*parts: Column) -> Column:
    """Twelve hexadecimal digits that name some content."""
    return F.substring(F.sha1(F.concat_ws("\u0000", *parts)), 1, 12)


# Units of a duration in milliseconds.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: Column) -> Column:
    """Milliseconds of "3d", "1.5h", "90 min"; a bare number is minutes; null if it can't be read."""
    pattern = r"(?i)^(\d+(?:\.\d+)?)\s*(ms|s|m|min|h|d|w)?\z"
    plain = F.trim(text)
    n = F.regexp_extract(plain, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(plain, pattern, 2))
    factor = F.lit(None).cast("long")
    for name, ms in UNITS.items():
        factor = F.when(unit == name, F.lit(ms)).otherwise(factor)
    return F.when(plain.rlike(pattern), F.round(n * F.when(unit == "", F.lit(60_000)).otherwise(factor)).cast("long"))


def age(ms: Column) -> Column:
    """"5m ago", "3h ago", "2d ago"; "unknown" of null."""
    told = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f"{unit} ago"))
    half_up = lambda x: F.floor(x + 0.5)
    return (
        F.when(ms.isNull(), "unknown")
        .when(ms < 3_600_000, told(F.greatest(F.lit(1), half_up(ms / 60_000)), "m"))
        .when(ms < 172_800_000, told(half_up(ms / 3_600_000), "h"))
        .otherwise(told(half_up(ms / 86_400_000), "d"))
    )


def fits_integrity(content: Column, integrity: Column) -> Column:
    """Whether bytes are what an integrity string says; of several hashes the strongest kind counts; null without one that can be checked."""
    parts = F.split(F.trim(F.coalesce(integrity, F.lit(""))), r"\s+")
    of = lambda kind: F.filter(parts, lambda x: F.startswith(x, F.lit(f"{kind}-")))
    made = {"sha512": _base64(F.sha2(content, 512)), "sha384": _base64(F.sha2(content, 384)), "sha256": _base64(F.sha2(content, 256)), "sha1": _base64(F.sha1(content))}
    one = lambda kind: F.array_contains(F.transform(of(kind), lambda x: F.regexp_extract(x, rf"^{kind}-([^?]*)", 1)), made[kind])
    out = F.lit(None).cast("boolean")
    for kind in reversed(made):
        out = F.when(F.size(of(kind)) > 0, one(kind)).otherwise(out)
    return out
