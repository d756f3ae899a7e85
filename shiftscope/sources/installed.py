"""What is installed and how it is asked for: copies, overrides, patches, registries, entry points.

Files are a table: path string, content string. Copies on disk are a table of what a lister saw: path (of a package's
folder), real_path (where links lead), content (of its package.json).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, paths, semver
from ..operators import graphs

#: Files that a wildcard entry stands for, besides those that are asked for.
WILDCARD = 50

# Blocks of a manifest whose strings aren't settings, and runtime conditions in the order in which they are tried.
NO_SETTINGS = [
    "dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "peerDependenciesMeta", "bundleDependencies", "bundledDependencies",
    "overrides", "resolutions", "name", "scripts", "pnpm", "workspaces", "catalog", "catalogs",
]
CONDITIONS = ["import", "require", "node", "default", "module"]


def copies(declarations: DataFrame, found: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """dir, key, path, name, version, local: the copy that each declaration (dir, key) gets, from the nearest node_modules above.

    found: path (`<folder>/node_modules/<key>`), real_path, content. stop: dir, stop_at (the folder of the lockfile, above
    which nothing is looked for). A copy whose real path lies in no node_modules is the project's own. A copy whose
    manifest can't be read is as none, and ends the search.
    """
    form = r"^(?:(.*)/)?node_modules/((?:@[^/]+/)?[^/]+)\z"
    json = F.try_parse_json("content")
    own = found.filter(F.col("path").rlike(form)).select(F.regexp_extract("path", form, 1).alias("above"), F.regexp_extract("path", form, 2).alias("key"), "path", (~F.array_contains(F.split("real_path", "/"), "node_modules")).alias("local"), json.isNotNull().alias("read"), F.try_variant_get(json, "$.name", "string").alias("name"), F.try_variant_get(json, "$.version", "string").alias("version"))
    rows = declarations.select("dir", "key").distinct()
    rows = rows.join(stop, "dir", "left") if stop is not None else rows.withColumn("stop_at", F.lit(None).cast("string"))
    above = rows.withColumn("above", F.explode(paths.folders(F.concat(F.col("dir"), F.lit("/x"))))).filter(F.col("stop_at").isNull() | (F.length("above") >= F.length("stop_at")))
    near = above.join(own, ["above", "key"]).groupBy("dir", "key").agg(F.max_by(F.struct("path", "name", "version", "local", "read"), F.length("above")).alias("c"))
    return near.filter("c.read").select("dir", "key", "c.path", F.coalesce("c.name", "key").alias("name"), F.coalesce("c.version", F.lit("0.0.0")).alias("version"), "c.local")


def _selected(selector: Column) -> Column:
    """The package that an override's selector names: b of `a>b`, `**/b` and `b@<2`."""
    last = F.trim(F.regexp_extract(F.regexp_extract(selector, r"([^>]*)\z", 1), r"(?:^|\*\*/)((?:(?!\*\*/).)*)\z", 1))
    scoped = F.regexp_extract(last, r"^(@[^/@]+/[^/@]+)", 1)
    return F.when(scoped != "", scoped).otherwise(F.regexp_extract(F.regexp_extract(last, r"([^/]*)\z", 1), r"^([^/@]+)", 1))


def _block(content: Column, name: str) -> Column:
    """The indented lines below `name:` of a YAML file."""
    return F.split(F.regexp_extract(content, rf"(?m)^{name}:\s*\n((?:[ \t]+.*\n?)*)", 1), "\n")


def _dir() -> Column:
    return F.regexp_replace("path", r"/?[^/]+\z", "").alias("dir")


def overridden(files: DataFrame) -> DataFrame:
    """dir, name: packages that a project forces to another version, by overrides and resolutions of manifests and workspaces.

    Overrides nest; each round goes one object deeper, and ends where none is left.
    """
    manifests = files.filter(F.col("path").rlike(r"(^|/)package\.json\z")).select(_dir(), F.try_parse_json("content").alias("j"))
    level = None
    for path in ("$.overrides", "$.resolutions", "$.pnpm.overrides"):
        part = manifests.select("dir", F.explode(F.try_variant_get("j", path, "map<string,variant>")).alias("k", "v"))
        level = part if level is None else level.unionByName(part)
    # each level is written once, so that a round reads only the one above it
    level = graphs.written(level.select("dir", "k", F.to_json("v").alias("v")), "overrides")
    out = level.select("dir", "k")
    while not level.isEmpty():
        level = graphs.written(level.select("dir", F.explode(F.try_variant_get(F.try_parse_json("v"), "$", "map<string,variant>")).alias("k", "x")).select("dir", "k", F.to_json("x").alias("v")), "overrides")
        out = out.unionByName(level.select("dir", "k"))
    spaces = files.filter(F.col("path").rlike(r"(^|/)pnpm-workspace\.yaml\z")).select(_dir(), F.explode(_block(F.col("content"), "overrides")).alias("line"))
    lines = spaces.select("dir", F.regexp_extract("line", r"""^\s+['"]?([^'":]+?)['"]?\s*:""", 1).alias("k"))
    return out.filter("k <> '.'").unionByName(lines.filter("k <> ''")).select("dir", _selected(F.col("k")).alias("name")).filter("name <> ''").distinct()


def patched(files: DataFrame) -> DataFrame:
    """name: packages patched in the project: by files of patches/, the root manifest and the workspace file."""
    file = F.regexp_extract("path", r"^patches/([^/]+)\z", 1)
    plus, at = F.regexp_extract(file, r"^(.+)\+\d[^+]*\.patch\z", 1), F.regexp_extract(file, r"^(.+)@\d.*\.patch\z", 1)
    named = files.select(F.explode(F.array(F.regexp_replace(plus, r"^(@[^+]+)\+", "$1/"), F.regexp_replace(at, r"^(@[^_]+)__", "$1/"))).alias("name"))
    root = files.filter("path = 'package.json'").select(F.explode(F.map_keys(F.try_variant_get(F.try_parse_json("content"), "$.pnpm.patchedDependencies", "map<string,variant>"))).alias("k"))
    bare = F.regexp_replace("k", r"@[^@]*\z", "")
    keys = root.select(F.when(bare != "", bare).otherwise(F.col("k")).alias("name"))
    spaces = files.filter("path = 'pnpm-workspace.yaml'").select(F.explode(_block(F.col("content"), "patchedDependencies")).alias("line"))
    lines = spaces.select(F.regexp_extract("line", r"""^\s+['"]?(@?[^@'":\s]+)(?:@[^'":]*)?['"]?:""", 1).alias("name"))
    return named.unionByName(keys).unionByName(lines).filter("name <> ''").distinct()


def settings(files: DataFrame, env: dict[str, str]) -> DataFrame:
    """path, key, value of .npmrc files, `${NAME}` filled in from env; of repeated keys the last counts."""
    values = F.create_map(*[F.lit(x) for k, v in env.items() for x in (k, v)]) if env else F.lit(None).cast("map<string,string>")
    own = files.filter(F.col("path").rlike(r"(^|/)\.npmrc\z")).select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    rows = own.filter(F.col("line").rlike("^[^#;].*=|^=")).select("path", "pos", F.trim(F.regexp_extract("line", "^([^=]*)=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1)), r'^"(.*)"\z', "$1").alias("value"))
    pieces = F.regexp_extract_all("value", F.lit(r"\$\{[^}]+\}|(?:(?!\$\{[^}]+\})[\s\S])+"), F.lit(0))
    filled = F.transform(pieces, lambda p: F.when(p.rlike(r"^\$\{[^}]+\}\z"), F.coalesce(F.try_element_at(values, F.regexp_extract(p, r"^\$\{([^}]+)\}\z", 1)), F.lit(""))).otherwise(p))
    return rows.withColumn("value", F.array_join(filled, "")).groupBy("path", "key").agg(F.max_by("value", "pos").alias("value"))


def registries(rules: DataFrame) -> DataFrame:
    """scope (null for the default), registry. rules: key, value."""
    scope = F.regexp_extract("key", r"^(@[^:]+):registry\z", 1)
    own = rules.filter((F.col("key") == "registry") | (scope != ""))
    return own.select(F.when(scope != "", scope).alias("scope"), F.regexp_replace("value", r"/+\z", "").alias("registry"))


def tokens(rules: DataFrame) -> DataFrame:
    """prefix (host and path without a slash at its end), token. rules: key, value."""
    prefix = F.regexp_replace(F.regexp_extract("key", r"^//(.+?)/?:_authToken\z", 1), r"/\z", "")
    return rules.select(prefix.alias("prefix"), F.col("value").alias("token")).filter("prefix <> '' and token <> ''")


def registry_for(packages: DataFrame, known: DataFrame, default: str = "https://registry.npmjs.org") -> DataFrame:
    """pkg, registry: its scope's, else the default one."""
    scope = F.regexp_extract("pkg", r"^(@[^/]+)/", 1)
    own = known.filter("scope is not null").groupBy("scope").agg(F.max("registry").alias("own"))
    base = known.filter("scope is null").agg(F.max("registry").alias("base")).withColumn("one", F.lit(1))
    met = packages.withColumns({"scope": scope, "one": F.lit(1)}).join(own, "scope", "left").join(F.broadcast(base), "one", "left")  # base is one row
    return met.select("pkg", F.coalesce("own", "base", F.lit(default)).alias("registry"))


def authorized(urls: DataFrame, known: DataFrame) -> DataFrame:
    """url, token: that of the longest prefix of the address; null without one. Prefixes meet addresses by equality."""
    host = F.regexp_replace("url", "^https?://", "")
    ends = F.sequence(F.lit(1), F.length(host))
    each = urls.select("url", F.explode(F.transform(ends, lambda k: F.substr(host, F.lit(1), k))).alias("prefix"))
    best = each.join(known, "prefix").groupBy("url").agg(F.max_by("token", F.length("prefix")).alias("token"))
    return urls.select("url").join(best, "url", "left")


def release_age(files: DataFrame, env: dict[str, str]) -> DataFrame:
    """ms, source, excluded: the least age of a release that a project asks for; the workspace file's before .npmrc's. One row."""
    own = settings(files.filter("path = '.npmrc'"), env).filter("key = 'minimum-release-age'").select(F.lit(1).alias("rank"), numbers.duration_ms(F.col("value")).alias("ms"), F.lit(".npmrc minimum-release-age").alias("source"), F.array().cast("array<string>").alias("excluded"))
    spaces = files.filter("path = 'pnpm-workspace.yaml'")
    age = F.regexp_extract("content", r"(?m)^minimumReleaseAge:\s*(\d+)\s*$", 1)
    names = F.filter(F.transform(_block(F.col("content"), "minimumReleaseAgeExclude"), lambda x: F.regexp_extract(x, r"""^\s+-\s+['"]?([^'"\s]+)['"]?""", 1)), lambda x: x != "")
    theirs = spaces.select(F.lit(0).alias("rank"), (age.try_cast("long") * 60_000).alias("ms"), F.when(age != "", "pnpm-workspace.yaml minimumReleaseAge").alias("source"), names.alias("excluded"))
    both = own.unionByName(theirs)
    least = F.min_by(F.struct("ms", "source"), F.when(F.col("ms").isNotNull(), F.col("rank")))
    return both.agg(least.alias("x"), F.flatten(F.collect_list("excluded")).alias("excluded")).select("x.ms", "x.source", "excluded")


def is_age_excluded(pkg: Column, version: Column, patterns: Column) -> Column:
    """Whether a release may be younger: by `name`, `@scope/*`, or `name@1.0.0 || 2.0.0`."""

    def one(p: Column) -> Column:
        name = F.when(p.rlike("^.+@"), F.regexp_extract(p, "^(.+)@", 1)).otherwise(p)
        versions = F.transform(F.split(F.regexp_extract(p, r"^.+@([^@]*)\z", 1), r"\|\|"), lambda v: F.trim(v))
        fits = F.when(name.endswith("*"), F.startswith(pkg, F.substr(name, F.lit(1), F.length(name) - 1))).otherwise(pkg == name)
        return fits & (~p.rlike("^.+@") | F.array_contains(versions, version))

    return F.exists(patterns, one)


def declares_types(manifest: Column) -> Column:
    """Whether a version (JSON) ships its own declarations; null where its manifest doesn't tell."""
    json = F.try_parse_json(manifest)
    text = lambda k: F.coalesce(F.try_variant_get(json, f"$.{k}", "string"), F.lit("")) != ""
    exports = F.to_json(F.try_variant_get(json, "$.exports", "variant"))
    return F.when(text("types") | text("typings") | exports.rlike(r'"types"|\.d\.[cm]?ts"'), True)


def highest(ranges: DataFrame, releases: DataFrame, tags: DataFrame) -> DataFrame:
    """name, range, version: what a range picks today: a tag's version if it is one, else the highest release that satisfies it; null if none.

    ranges: name, range; releases: name, version; tags: name, tag, version.
    """
    own = ranges.select("name", "range").distinct()
    known = releases.select("name", "version").distinct()
    tagged = own.join(tags.select("name", F.col("tag").alias("range"), "version"), ["name", "range"]).join(known, ["name", "version"], "left_semi").select("name", "range", F.col("version").alias("tagged"))
    # each range and each version is parsed once; pairs compare keys, and the highest is a partial aggregate
    core = F.concat_ws(".", *[semver.part("version", k) for k in (1, 2, 3)])
    parsed = graphs.written(own.select("range").distinct().withColumn("bounds", semver.bounds("range")), "ranges")
    keyed = known.select("name", "version", semver.key("version").alias("key"), semver.is_stable("version").alias("stable"), F.concat(core, F.lit("-")).alias("core"))
    pairs = own.join(parsed, "range").join(keyed.filter("key is not null"), "name")
    # a prerelease only satisfies a range that names one of its own version
    fits = F.coalesce(semver.within(F.col("key"), F.col("bounds")), F.lit(False)) & (F.col("stable") | F.contains(F.col("range"), F.col("core")))
    fit = pairs.filter(fits).groupBy("name", "range").agg(F.max_by("version", "key").alias("best"))
    return own.join(tagged, ["name", "range"], "left").join(fit, ["name", "range"], "left").select("name", "range", F.coalesce("tagged", "best").alias("version"))


def imported_dependencies(manifest: DataFrame, imports: DataFrame) -> DataFrame:
    """pkg, name, range: dependencies and peers of a version that its declarations import, themselves or by their types' package.

    manifest: pkg, content (package.json); imports: pkg, specifier.
    """
    json = F.try_parse_json("content")
    block = lambda b: F.coalesce(F.try_variant_get(json, f"$.{b}", "map<string,string>"), F.create_map().cast("map<string,string>"))
    both = F.concat(F.transform(F.map_entries(block("peerDependencies")), lambda e: F.struct(F.lit(0).alias("rank"), e["key"].alias("name"), e["value"].alias("range"))), F.transform(F.map_entries(block("dependencies")), lambda e: F.struct(F.lit(1).alias("rank"), e["key"].alias("name"), e["value"].alias("range"))))
    ranges = manifest.select("pkg", F.explode(both).alias("d")).groupBy("pkg", F.col("d.name").alias("name")).agg(F.max_by("d.range", "d.rank").alias("range")).filter("range is not null")
    own = imports.select("pkg", paths.package_of(F.col("specifier")).alias("p")).filter("p is not null")
    asked = own.select("pkg", F.explode(F.array(F.col("p"), paths.types_package(F.col("p")))).alias("name")).filter("name <> pkg").distinct()
    return ranges.join(asked, ["pkg", "name"], "left_semi")


def all_strings(documents: DataFrame, rounds: int = 20) -> DataFrame:
    """path, value: every string in a JSON file, to a depth of `rounds`, each as often as it stands; manifests' dependencies and scripts are no settings.

    documents: path, content. Each round reads the level above, written once, and the last is empty.
    """
    level = graphs.written(documents.filter(F.try_parse_json("content").isNotNull()).select("path", F.col("content").alias("v")), "json")
    out = None
    for depth in range(rounds + 1):
        json = F.try_parse_json("v")
        kind = F.schema_of_variant(json)
        here = level.filter(kind == "STRING").select("path", F.try_variant_get(json, "$", "string").alias("value"))
        out = here if out is None else out.unionByName(here)
        if depth == rounds or level.isEmpty():
            break
        items = level.filter(F.startswith(kind, F.lit("ARRAY"))).select("path", F.explode(F.try_variant_get(json, "$", "array<variant>")).alias("x")).withColumn("k", F.lit(""))
        fields = level.filter(F.startswith(kind, F.lit("OBJECT"))).select("path", F.explode(F.try_variant_get(json, "$", "map<string,variant>")).alias("k", "x"))
        if depth == 0:
            fields = fields.filter(~(F.col("path").rlike(r"(^|/)package\.json\z") & F.col("k").isin(NO_SETTINGS)))
        level = graphs.written(items.unionByName(fields.select("path", "x", "k")).select("path", F.to_json("x").alias("v")).filter("v is not null"), "json")
    return out


def binaries(manifests: DataFrame) -> DataFrame:
    """pkg, bin: commands that installed packages bring. manifests: pkg, content (null if it isn't known where it is)."""
    json = F.try_parse_json("content")
    bare = lambda c: F.regexp_extract(c, r"([^/]+)\z", 1)
    said = F.try_variant_get(json, "$.bin", "variant")
    one = F.when(F.schema_of_variant(said) == "STRING", F.try_variant_get(json, "$.bin", "string"))
    many = F.map_keys(F.try_variant_get(json, "$.bin", "map<string,variant>"))
    names = F.when(F.col("content").isNull(), F.array(bare(F.col("pkg")))).when(one.isNotNull(), F.array(bare(F.coalesce(F.try_variant_get(json, "$.name", "string"), F.col("pkg"))))).otherwise(F.coalesce(many, F.array().cast("array<string>")))
    return manifests.select("pkg", F.explode(names).alias("bin")).distinct()
