"""Semantic versions as columns: parsing, ordering, bumps and ranges, without UDFs.

A version that isn't semver has a null key; comparisons with it are null, and `version_order` puts it before all
others by its text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(version: Column | str, k: int) -> Column:
    """Group k of a version (1 major, 2 minor, 3 patch, 4 prerelease); null where it isn't semver."""
    v = _col(version)
    return F.when(v.rlike(_FORM), F.regexp_extract(v, _FORM, k))


def key(version: Column | str) -> Column:
    """A struct that orders as the specification does: release after its prereleases, numbers before words."""
    v = _col(version)
    pieces = F.when(part(v, 4) == "", F.array().cast("array<string>")).otherwise(F.split(part(v, 4), r"\."))
    ordered = F.transform(
        pieces,
        lambda p: F.struct(
            (~p.rlike(r"^\d+\z")).alias("word"),
            F.when(p.rlike(r"^\d+\z"), p.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("n"),
            F.when(p.rlike(r"^\d+\z"), "").otherwise(p).alias("text"),
        ),
    )
    return F.when(
        v.rlike(_FORM),
        F.struct(*[part(v, k).cast("decimal(38,0)").alias(c) for k, c in ((1, "major"), (2, "minor"), (3, "patch"))], (part(v, 4) == "").alias("release"), ordered.alias("pre")),
    )


def version_order(version: Column | str) -> Column:
    v = _col(version)
    return F.struct(key(v).isNotNull().alias("semver"), key(v).alias("key"), v.alias("text"))


def is_stable(version: Column | str) -> Column:
    return F.coalesce(part(version, 4) == "", F.lit(False))


def bump(a: Column | str, b: Column | str) -> Column:
    """major, minor or patch from a up to b; 0.x minors and 0.0.x patches are majors, and so is what can't be read."""
    same = lambda k: part(a, k) == part(b, k)
    zero = lambda k: part(a, k) == "0"
    return (
        F.when(key(a).isNull() | key(b).isNull() | ~same(1), "major")
        .when(zero(1) & ~same(2), "major")
        .when(~same(2), "minor")
        .when(zero(1) & zero(2) & ~same(3), "major")
        .otherwise("patch")
    )


def same_line(installed: Column | str, v: Column | str) -> Column:
    """Whether v lies on the caret line of the installed version."""
    same = lambda k: part(installed, k) == part(v, k)
    above = lambda k: part(installed, k) != "0"
    return same(1) & (above(1) | (same(2) & (above(2) | same(3))))


def between(v: Column | str, low: Column | str, high: Column | str) -> Column:
    """Stable versions above low, up to high."""
    return is_stable(v) & (key(v) > key(low)) & (key(v) <= key(high))


def satisfies(v: Column | str, declared: Column | str) -> Column:
    """Whether v lies in a declared range: alternatives of ^, ~, comparisons, hyphens, x-ranges; prereleases included.

    Null where the range can't be read, so that callers decide; `*`, `latest` and the empty range allow all. Where many
    versions meet many ranges, each is better parsed once, by `bounds` and `key`, and held together by `within`.
    """
    return within(key(v), bounds(declared))


def within(version_key: Column, ranges: Column) -> Column:
    """satisfies() for a version's key and a range's bounds: keys are compared, no text is read."""
    low = lambda x: x["low"].isNull() | F.when(x["low_open"], version_key > x["low"]).otherwise(version_key >= x["low"])
    high = lambda x: x["high"].isNull() | F.when(x["high_open"], version_key < x["high"]).otherwise(version_key <= x["high"])
    some = F.exists(ranges, lambda one: F.coalesce(F.forall(one, lambda x: low(x) & high(x)), F.lit(False)))
    return F.when(version_key.isNull() | ranges.isNull(), None).when(some, True).when(F.exists(ranges, lambda one: one.isNull()), None).otherwise(False)


def bounds(declared: Column | str) -> Column:
    """A range parsed: for each alternative the intervals that must all hold, array<struct<low, low_open, high, high_open>>; null
    for one that can't be read, no interval for one that allows all.

    Each step is an array of its own, so that no pattern is matched twice.
    """
    return F.transform(F.split(F.trim(_col(declared)), r"\s*\|\|\s*"), lambda one: _intervals(F.trim(one)))


_ONE = r"(?:>=|<=|>|<|=|\^|~)?\s*v?(?:\d+|[xX*])(?:\.(?:\d+|[xX*])){0,2}(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?"
_SOME = rf"(?:{_ONE}(?:\s+-\s+{_ONE}|(?:\s+{_ONE})*)|)"
_RANGE = rf"^{_SOME}(?:\s*\|\|\s*{_SOME})*\z"


def is_range(declared: Column | str) -> Column:
    """Whether a specifier is written as a range: alternatives of comparators, hyphens and x-ranges."""
    return F.trim(_col(declared)).rlike(_RANGE)


def _bound(text: Column, k: int) -> Column:
    return F.regexp_extract(text, r"^[\^~]?v?(\d+|[xX*])?(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?", k)


_HYPHEN = r"^(\S+)\s+-\s+(\S+)\z"
_OPERATOR = r"^(>=|<=|>|<|=|\^|~)?(.*)\z"
_PARTIAL = r"^v?\d+(\.(\d+|[xX*]))?(\.(\d+|[xX*]))?(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?\z"
_NO_PRE = "array<struct<word:boolean,n:decimal(38,0),text:string>>"


def _intervals(one: Column) -> Column:
    """One alternative: the intervals of its comparators."""
    comparators = F.when(one.rlike(_HYPHEN), F.array(F.concat(F.lit(">="), F.regexp_extract(one, _HYPHEN, 1)), F.concat(F.lit("<="), F.regexp_extract(one, _HYPHEN, 2)))).otherwise(
        F.split(F.regexp_replace(one, r"([<>=^~])\s+", "$1"), r"\s+")
    )
    cut = F.transform(comparators, lambda c: F.struct(F.regexp_extract(c, _OPERATOR, 1).alias("op"), F.regexp_extract(c, _OPERATOR, 2).alias("text")))
    read = F.transform(cut, lambda x: F.struct(x["op"].alias("op"), x["text"].rlike(_PARTIAL).alias("sound"), key(x["text"]).alias("exact"), *[_bound(x["text"], k).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "c"))]))
    is_open = lambda x: x.rlike(r"^([xX*])?\z")
    number = lambda x: F.when(is_open(x), F.lit(0)).otherwise(x.cast("decimal(38,0)"))
    known = F.transform(read, lambda x: F.struct(x["op"].alias("op"), x["sound"].alias("sound"), x["exact"].alias("exact"), *[number(x[c]).alias(c) for c in "abc"], is_open(x["b"]).alias("b_open"), is_open(x["c"]).alias("c_open")))
    held = F.transform(known, _interval)
    everything = F.array().cast(held_type())
    return F.when(one.rlike(r"^(\*|x|X|latest)?\z"), everything).when(F.exists(held, lambda h: h.isNull()), None).otherwise(held)


def held_type() -> str:
    """The type of one alternative's intervals."""
    of = f"struct<major:decimal(38,0),minor:decimal(38,0),patch:decimal(38,0),release:boolean,pre:{_NO_PRE}>"
    return f"array<struct<low:{of},low_open:boolean,high:{of},high_open:boolean>>"


def _interval(x: Column) -> Column:
    """What a comparator allows: op with the numbers a, b and c, of which b and c may be open."""
    empty = F.array().cast(_NO_PRE)
    tri = lambda a, b, c, release=True: F.struct(a.cast("decimal(38,0)").alias("major"), b.cast("decimal(38,0)").alias("minor"), c.cast("decimal(38,0)").alias("patch"), F.lit(release).alias("release"), empty.alias("pre"))
    a, b, c, op, zero = x["a"], x["b"], x["c"], x["op"], F.lit(0)
    low = F.coalesce(x["exact"], tri(a, b, c))
    # the first version beyond: what a partial version, ~ or ^ covers ends before its lowest prerelease
    major, minor, patch = tri(a + 1, zero, zero, False), tri(a, b + 1, zero, False), tri(a, b, c + 1, False)
    tilde = F.when(x["b_open"], major).otherwise(minor)
    caret = F.when((a > 0) | x["b_open"], major).when((b > 0) | x["c_open"], minor).otherwise(patch)
    partial = x["b_open"] | x["c_open"]
    item = held_type()[len("array<") : -1]
    none = F.lit(None)
    span = lambda lo, lo_open, hi, hi_open: F.struct(lo.alias("low"), F.lit(lo_open).alias("low_open"), hi.alias("high"), F.lit(hi_open).alias("high_open")).cast(item)
    return (
        F.when(~x["sound"], none)
        .when(op == "^", span(low, False, caret, True))
        .when(op == "~", span(low, False, tilde, True))
        .when(op == ">=", span(low, False, none, False))
        .when(op == "<", span(none, False, low, True))
        .when(op == ">", F.when(partial, span(tilde, False, none, False)).otherwise(span(low, True, none, False)))
        .when(op == "<=", F.when(partial, span(none, False, tilde, True)).otherwise(span(none, False, low, False)))
        .when(partial, span(low, False, tilde, True))
        .otherwise(span(low, False, low, False))
    )
