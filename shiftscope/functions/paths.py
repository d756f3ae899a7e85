"""Package specs, addresses, and symbol paths `pkg/sub:a.b#c`, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import semver


def spec_name(spec: Column) -> Column:
    """`@a/b` of `@a/b@1.2`; an @ at the start isn't a version's."""
    return F.regexp_extract(spec, r"^(@?[^@]*)(?:@(.*))?\z", 1)


def spec_version(spec: Column) -> Column:
    found = F.regexp_extract(spec, r"^(@?[^@]*)(?:@(.*))?\z", 2)
    return F.when(found != "", found)


def spec_kind(spec: Column) -> Column:
    """What a declared specifier is, by the first rule that fits; white space around it doesn't count."""
    s = F.trim(spec)
    return (
        F.when(s.rlike(r"^workspace:"), "workspace")
        .when(s.rlike(r"^catalog:"), "catalog")
        .when(s.rlike(r"^link:"), "link")
        .when(s.rlike(r"^file:|^\.{1,2}/|^/|^~/"), "file")
        .when(s.rlike(r"^npm:"), "alias")
        .when(s.rlike(r"^(git\+|git:|github:|gitlab:|bitbucket:)|^[\w-]+/[\w.-]+(#.*)?\z"), "git")
        .when(s.rlike(r"^https?:"), "url")
        .when(s == "latest", "tag")
        .when((s == "") | semver.is_range(s), "range")
        .when(s.rlike(r"(?i)^[a-z][\w.-]*\z"), "tag")
        .otherwise("range")
    )


def alias_of(spec: Column) -> Column:
    """`a` of "npm:a@1"; null for what is no alias."""
    rest = F.regexp_extract(F.trim(spec), r"^npm:(.*)\z", 1)
    return F.when(F.startswith(F.trim(spec), F.lit("npm:")), F.when(rest.rlike("^.+@"), F.regexp_extract(rest, r"^(.+)@", 1)).otherwise(rest))


def range_of(spec: Column) -> Column:
    """What a specifier says of versions: an alias's part behind the last @."""
    return F.when(F.startswith(spec, F.lit("npm:")), F.regexp_replace(spec, r"^npm:.*@", "")).otherwise(spec)


def package_of(specifier: Column) -> Column:
    """The package of an import specifier; null for relative ones, aliases (#) and schemes."""
    found = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)
    return F.when(~specifier.rlike(r"^[./#]|(?i)^[a-z]+:") & (found != ""), found)


def subpath_of(specifier: Column) -> Column:
    return F.regexp_extract(specifier, r"^(?:@[^/]+/[^/]+|[^/]+)/?(.*)\z", 1)


def types_package(name: Column) -> Column:
    """The package that declares another's types."""
    return F.concat(F.lit("@types/"), F.when(F.startswith(name, F.lit("@")), F.regexp_replace(F.substring(name, 2, 1 << 20), "/", "__")).otherwise(name))


def typed_package(name: Column) -> Column:
    """The package whose types another declares: @a/b of @types/a__b; null of others."""
    bare = F.regexp_extract(name, r"^@types/(.*)\z", 1)
    return F.when(bare != "", F.when(F.contains(bare, F.lit("__")), F.concat(F.lit("@"), F.regexp_replace(bare, "^(.*?)__", "$1/"))).otherwise(bare))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def repository_key(url: Column) -> Column:
    """host/owner/name in lower case, from any of a repository address's spellings."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^git\+", ""), r"(\.git)?(#.*)?/?\z", "")
    short = plain.rlike(r"^(github:)?[\w.-]+/[\w.-]+\z")
    found = F.regexp_extract(plain, r"^(?:[a-z+]+://)?(?:[^@/]+@)?([^/:]+)[/:]([^/]+)/([^/]+)", 0)
    parts = lambda k: F.regexp_extract(plain, r"^(?:[a-z+]+://)?(?:[^@/]+@)?([^/:]+)[/:]([^/]+)/([^/]+)", k)
    return F.lower(F.when(short, F.concat(F.lit("github.com/"), F.regexp_replace(plain, r"^github:", ""))).when(found != "", F.concat_ws("/", parts(1), parts(2), parts(3))))


def segments(path: Column) -> Column:
    """The names of a symbol path behind its prefix, each with the separator before it."""
    return F.regexp_extract_all(F.regexp_extract(path, r"^[^:]*:(.*)\z", 1), F.lit(r"[.#]?[^.#]+"), F.lit(0))


def last_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^.#:]+)\z", 1)


def unit_name(qualified: Column) -> Column:
    """What a unit is called, behind its file, class and namespace."""
    return F.regexp_extract(qualified, r"([^/#.]*)\z", 1)


def record_file(pkg: Column, version: Column) -> Column:
    """The file that holds a version's change records."""
    return F.concat(F.regexp_replace(pkg, "^([^/]*)/", "$1__"), F.lit("@"), version, F.lit(".json"))


def path_rank(path: Column) -> Column:
    """Short entries first: ten for each part of the prefix, one for each name."""
    return F.size(F.split(F.regexp_extract(path, r"^([^:]*)", 1), "/")) * 10 + F.size(segments(path))


def ancestors(path: Column) -> Column:
    """All paths above a symbol path, the nearest last, itself not among them."""
    prefix, parts = F.regexp_extract(path, r"^([^:]*):", 1), segments(path)
    upto = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(upto, lambda k: F.concat(prefix, F.lit(":"), F.array_join(F.slice(parts, 1, k), "")))


def folders(path: Column) -> Column:
    """All folders above a slash path, the root "" first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
