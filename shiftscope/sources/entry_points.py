"""Entry points of packages, from export maps and the older fields of a manifest.

Tables: manifests (pkg, content: package.json), files (pkg, path). Conditions nest: each round opens one level of all
export maps, and the first target in order that a package has a file for is its entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semver
from ..operators import graphs
from .installed import CONDITIONS, WILDCARD

# Conditions in the order in which they are tried, or those that are active, in the order of the map.
TYPES = ["types", *CONDITIONS]
WORKSPACE = ["types", "import", "module", "default", "require", "node", "browser"]
ACTIVE = {"import": ["import", "module", "node", "default"], "require": ["require", "node", "default"]}
ENDINGS = [".js", ".mjs", ".cjs"]


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\./|/)", "")


def _fields(text: Column) -> Column:
    """A JSON object's fields in their order, nested values as text."""
    return F.from_json(text, "map<string,string>")


def _exports(manifests: DataFrame) -> DataFrame:
    """pkg, subpath, v of all keys of export maps but ./package.json."""
    own = manifests.select("pkg", _fields(F.col("content"))["exports"].alias("v")).filter("v is not null")
    keyed = F.startswith("v", F.lit("{")) & F.exists(F.map_keys(_fields(F.col("v"))), lambda k: F.startswith(k, F.lit(".")))
    one = own.filter(~keyed).select("pkg", F.lit(".").alias("subpath"), "v")
    many = own.filter(keyed).select("pkg", F.explode(_fields(F.col("v"))).alias("subpath", "v"))
    return one.unionByName(many).filter("v is not null and subpath <> './package.json'")


def _targets(exports: DataFrame, rank) -> DataFrame:
    """pkg, subpath, order, target: the strings of each export's tree, by place. rank: a condition's and its place's column, null to leave it out."""
    level = graphs.written(exports.select("pkg", "subpath", F.array().cast("array<int>").alias("order"), "v"), "exports")
    leaves = None
    while True:
        object_, array = F.startswith("v", F.lit("{")), F.startswith("v", F.lit("["))
        here = level.filter(~object_ & ~array).select("pkg", "subpath", "order", F.col("v").alias("target"))
        leaves = here if leaves is None else leaves.unionByName(here)
        fields = level.filter(object_).select("pkg", "subpath", "order", F.posexplode(F.map_entries(_fields(F.col("v")))).alias("at", "e")).select("pkg", "subpath", "order", rank(F.col("e.key"), F.col("at")).alias("at"), F.col("e.value").alias("v"))
        items = level.filter(array).select("pkg", "subpath", "order", F.posexplode(F.from_json("v", "array<string>")).alias("at", "v"))
        below = fields.unionByName(items).filter("at is not null and v is not null")
        level = graphs.written(below.select("pkg", "subpath", F.array_append("order", F.col("at").cast("int")).alias("order"), "v"), "exports")
        if level.isEmpty():
            return leaves


def _listed(conditions: list[str], others: bool = False):
    """A rank by the list; other conditions behind it in their own order, or left out."""

    def rank(key: Column, at: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, conditions)), key)
        return F.when(place > 0, place.cast("int")).otherwise(F.when(~F.startswith(key, F.lit(".")), at + 100) if others else F.lit(None).cast("int"))

    return rank


def declarations_for(path: Column) -> Column:
    """Declaration files that a target stands for: itself, or what lies beside a script or a source."""
    script = F.regexp_extract(path, r"\.(m|c)?js\z", 0)
    base = F.regexp_replace(path, r"\.(m|c)?js\z", "")
    kind = F.regexp_extract(path, r"\.(m|c)?js\z", 1)
    return (
        F.when(path.rlike(r"\.d\.[cm]?ts\z"), F.array(path))
        .when(script != "", F.array(F.concat(base, F.lit(".d."), kind, F.lit("ts")), F.concat(base, F.lit(".d.ts"))))
        .when(path.rlike(r"\.[cm]?ts\z"), F.array(F.regexp_replace(path, r"\.([cm]?)ts\z", ".d.$1ts")))
        .otherwise(F.array(F.concat(path, F.lit(".d.ts")), F.concat(path, F.lit("/index.d.ts"))))
    )


def scripts_for(path: Column) -> Column:
    """Runtime files that a target stands for, as a lookup without extension finds them."""
    own = F.when(path.rlike(r"\.[cm]?js\z"), F.array(path)).otherwise(F.array().cast("array<string>"))
    return F.concat(own, *[F.array(F.concat(path, F.lit(e))) for e in ENDINGS], *[F.array(F.concat(path, F.lit(f"/index{e}"))) for e in ENDINGS])


def _entries(manifests: DataFrame, files: DataFrame, rank, candidates, older: DataFrame, extension: str, wanted: DataFrame | None) -> DataFrame:
    exports = _exports(manifests)
    targets = graphs.written(_targets(exports, rank), "targets")
    star = targets.filter(F.contains("subpath", F.lit("*")))
    # what a wildcard stands for: names of files between the two ends of the first target
    first = star.groupBy("pkg", "subpath").agg(F.min_by("target", "order").alias("pattern")).filter(F.contains("pattern", F.lit("*")))
    ends = F.split(_plain(F.col("pattern")), r"\*")
    rest = F.substr("path", F.length(F.get(ends, F.lit(0))) + 1)
    tail = F.get(ends, F.lit(1))
    name = F.when(tail == "", F.regexp_replace(rest, extension, "")).when(rest.endswith(tail), F.substr(rest, F.lit(1), F.length(rest) - F.length(tail)))
    found = first.join(files, "pkg").filter(F.startswith("path", F.get(ends, F.lit(0)))).select("pkg", "subpath", name.alias("star")).filter("star <> '' and not contains(star, '/')").distinct()
    place = found.withColumn("place", F.row_number().over(Window.partitionBy("pkg", "subpath").orderBy("star"))).withColumn("real", F.concat(F.get(F.split("subpath", r"\*"), F.lit(0)), "star", F.get(F.split("subpath", r"\*"), F.lit(1))))
    asked = wanted.select("pkg", F.col("subpath").alias("real"), F.lit(True).alias("asked")).distinct() if wanted is not None else None
    told = place.join(asked, ["pkg", "real"], "left") if asked is not None else place.withColumn("asked", F.lit(None).cast("boolean"))
    kept = told.filter((F.col("place") <= WILDCARD) | F.coalesce("asked", F.lit(False)))
    cut = told.filter((F.col("place") > WILDCARD) & ~F.coalesce("asked", F.lit(False))).select("pkg").distinct().withColumn("truncated", F.lit(True))
    stars = star.join(kept.select("pkg", "subpath", "real", "star"), ["pkg", "subpath"]).select("pkg", F.col("real").alias("subpath"), "order", F.replace("target", F.lit("*"), F.col("star")).alias("target"))
    plain = targets.filter(~F.contains("subpath", F.lit("*"))).unionByName(stars)
    mapped = exports.select("pkg").distinct()
    every = plain.unionByName(older.join(mapped, "pkg", "left_anti"))
    each = every.select("pkg", "subpath", "order", F.posexplode(candidates(_plain(F.col("target")))).alias("at", "path"))
    best = each.join(files.select("pkg", "path").distinct(), ["pkg", "path"]).groupBy("pkg", "subpath").agg(F.min_by("path", F.struct("order", "at")).alias("file"))
    return best.join(cut, "pkg", "left").select("pkg", "subpath", "file", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def _older(manifests: DataFrame, fields: list[Column], last: str | None) -> DataFrame:
    """The main entry of manifests without an export map: the fields in order."""
    own = manifests.select("pkg", F.posexplode(F.array(*fields, *([F.lit(last)] if last else []))).alias("at", "target")).filter("target is not null")
    return own.select("pkg", F.lit(".").alias("subpath"), F.array(F.col("at").cast("int")).alias("order"), "target")


def type_entries(manifests: DataFrame, files: DataFrame, wanted: DataFrame | None = None, typescript: str = "5.9.0") -> DataFrame:
    """pkg, subpath, file, truncated: the declaration file of each entry point.

    wanted: pkg, subpath of the entries in use, which a wildcard keeps beyond WILDCARD and a package without an export
    map has by its path. truncated: whether a wildcard of the package stood for more.
    """
    field = lambda k: _fields(F.col("content"))[k]
    main = F.coalesce(field("types"), field("typings"))
    versions = F.map_entries(_fields(field("typesVersions")))
    fits = F.get(F.filter(versions, lambda e: (e["key"] == "*") | F.coalesce(semver.satisfies(F.lit(typescript), e["key"]), F.lit(False))), F.lit(0))["value"]
    other = F.get(F.from_json(_fields(fits)["*"], "array<string>"), F.lit(0))
    moved = F.when(other.isNotNull(), F.replace(other, F.lit("*"), F.regexp_replace(F.coalesce(main, F.lit("index.d.ts")), r"^\./", ""))).otherwise(main)
    older = _older(manifests, [moved, field("main")], "index.d.ts")
    if wanted is not None:
        older = older.unionByName(wanted.filter("subpath <> '.'").select("pkg", "subpath", F.array(F.lit(0)).alias("order"), F.col("subpath").alias("target")))
    return _entries(manifests, files, _listed(TYPES), declarations_for, older, r"\.d\.[cm]?ts\z|\.[cm]?js\z", wanted)


def flavor(before: DataFrame, after: DataFrame) -> DataFrame:
    """pkg, flavor: import if both versions ship a build of modules, else require. Tables: pkg, content."""
    modules = lambda df, c: df.select("pkg", (_fields(F.col("content"))["module"].isNotNull() | F.coalesce(_fields(F.col("content"))["exports"].rlike(r'"(import|module)"\s*:'), F.lit(False))).alias(c))
    return modules(before, "a").join(modules(after, "b"), "pkg").select("pkg", F.when(F.col("a") & F.col("b"), "import").otherwise("require").alias("flavor"))


def runtime_entries(manifests: DataFrame, files: DataFrame, build: str) -> DataFrame:
    """pkg, subpath, file, truncated: the runtime file of each entry point for a build, `import` or `require`."""
    field = lambda k: _fields(F.col("content"))[k]
    older = _older(manifests, [field("module"), field("main"), F.lit("index.js")] if build == "import" else [field("main"), F.lit("index.js"), field("module")], None)
    active = lambda key, at: F.when(key.isin(ACTIVE[build]), at)
    return _entries(manifests, files, active, scripts_for, older, r"\.[cm]?js\z", None)


def workspace_targets(manifests: DataFrame, asked: DataFrame) -> DataFrame:
    """pkg, subpath, target: what a workspace package's export map says of a subpath (asked: pkg, subpath); exact keys before wildcards."""
    exports = _exports(manifests)
    targets = _targets(exports, _listed(WORKSPACE, True)).groupBy("pkg", F.col("subpath").alias("key")).agg(F.min_by("target", "order").alias("target"))
    exact = asked.join(targets.withColumnRenamed("key", "subpath"), ["pkg", "subpath"]).select("pkg", "subpath", F.lit(0).alias("rank"), "target")
    pre, post = F.get(F.split("key", r"\*"), F.lit(0)), F.get(F.split("key", r"\*"), F.lit(1))
    fits = F.contains("key", F.lit("*")) & F.startswith("subpath", pre) & F.endswith("subpath", post) & (F.length("subpath") >= F.length(pre) + F.length(post))
    star = F.substr("subpath", F.length(pre) + 1, F.length("subpath") - F.length(pre) - F.length(post))
    wild = asked.join(targets, "pkg").filter(fits).select("pkg", "subpath", F.lit(1).alias("rank"), F.replace("target", F.lit("*"), star).alias("target"))
    return exact.unionByName(wild).groupBy("pkg", "subpath").agg(F.min_by("target", F.struct("rank", "target")).alias("target"))
