"""Usage: references attributed to packages through local files, and what runtime code an export reaches.

Tables:

* imports: file, local, specifier, imported; re_exports: file, name, specifier, imported ("*" for all);
* references: file, line, col, local, chain string; files: path; installed: pkg;
* units: pkg, version, unit, name, fp; edges: pkg, version, src, dst; exports: pkg, version, path, unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, paths
from . import graphs

# Endings of source files, in the order in which they are tried.
SOURCES = [".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro"]
HOPS = 12


def normalized(path: Column) -> Column:
    """A path without `.` and `..` parts; what leads above the root is null."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    held = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.array_append(acc, p)).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array(F.lit("\u0000"))))
    return F.when(~F.array_contains(held, "\u0000"), F.array_join(held, "/"))


def spelled(path: Column) -> Column:
    """Ways in which a path may be spelled on disk, in the order in which they are tried: itself, with an ending, an emitted name as its source, a folder's index."""
    emitted = r"\.(m|c)?jsx?\z"
    stem, kind = F.regexp_replace(path, emitted, ""), F.regexp_extract(path, emitted, 1)
    source = F.array(F.concat(stem, F.lit("."), kind, F.lit("ts")), F.concat(stem, F.lit("."), kind, F.lit("tsx")), F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")))
    none = F.array().cast("array<string>")
    return F.concat(F.array(path, *[F.concat(path, F.lit(e)) for e in SOURCES]), F.when(path.rlike(emitted), source).otherwise(none), F.array(*[F.concat(path, F.lit(f"/index{e}")) for e in SOURCES]))


def resolved(imports: DataFrame, files: DataFrame, installed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """imports with target (a file) or pkg, and unresolved: the first spelling on disk, else what an alias leads to, else the package if installed.

    aliases: file, specifier, target (settings.aliased).
    """
    rows = imports.withColumn("row", F.monotonically_increasing_id())
    rows = graphs.written(rows, "imports")
    folder = F.regexp_replace("file", r"/?[^/]+\z", "")
    local = rows.filter(F.col("specifier").rlike(r"^\.{1,2}(/|\z)")).select("row", F.posexplode(spelled(normalized(F.concat_ws("/", folder, "specifier")))).alias("pos", "path"))
    found = local.join(files.select("path"), "path").groupBy("row").agg(F.min_by("path", "pos").alias("target"))
    if aliases is not None:
        found = found.unionByName(rows.join(aliases.select("file", "specifier", "target"), ["file", "specifier"]).select("row", "target"))
    met = rows.join(found, "row", "left").withColumn("named", F.when(F.col("target").isNull(), paths.package_of(F.col("specifier"))))
    own = installed.select(F.col("pkg").alias("named"), F.col("pkg")).distinct()
    return met.join(own, "named", "left").withColumn("unresolved", F.col("target").isNull() & F.col("pkg").isNull()).drop("row", "named")


def origins(re_exports: DataFrame) -> DataFrame:
    """file, name, pkg, imported: where a name that a file hands on comes from, through at most HOPS files.

    re_exports: file, name, imported, target or pkg; a name given by itself goes before a star, and `default` never through one.
    Only the frontier is joined each round, and what was seen stays out.
    """
    edges = re_exports.select("file", "name", "imported", "target", "pkg")
    state = graphs.written(edges.select("file", "name", F.col("target").alias("at"), F.col("imported").alias("as"), "pkg"), "origins")
    done = state.filter("pkg is not null").select("file", "name", "pkg", F.col("as").alias("imported"))
    open_ = state.filter("pkg is null and at is not null").select("file", "name", "at", "as")
    seen = open_
    for _ in range(HOPS):
        e = edges.select(F.col("file").alias("at"), F.col("name").alias("e_name"), F.col("imported").alias("e_as"), F.col("target").alias("e_at"), "pkg")
        met = open_.join(e, "at").filter((F.col("e_name") == F.col("as")) | ((F.col("e_name") == "*") & (F.col("as") != "default")) | (F.col("as") == "*"))
        name = F.when(F.col("as") == "*", F.when(F.col("name") == "*", F.col("e_name")).otherwise(F.col("name"))).otherwise(F.col("name"))
        handed = F.when(F.col("e_name") == "*", F.when(F.col("as") == "*", F.lit("*")).otherwise(F.col("as"))).otherwise(F.col("e_as"))
        star = (F.col("e_name") == "*") & (F.col("as") != "*")
        best = met.withColumn("star", F.min(star.cast("int")).over(Window.partitionBy("file", "name", "at", "as"))).filter(star.cast("int") == F.col("star"))
        step = graphs.written(best.select("file", name.alias("name"), F.col("e_at").alias("at"), handed.alias("as"), "pkg").distinct(), "origins")
        done = done.unionByName(step.filter("pkg is not null").select("file", "name", "pkg", F.col("as").alias("imported")))
        open_ = graphs.written(step.filter("pkg is null and at is not null").select("file", "name", "at", "as").join(seen, ["file", "name", "at", "as"], "left_anti"), "origins")
        if open_.isEmpty():
            break
        seen = seen.unionByName(open_)
    return done.distinct()


def attributed(references: DataFrame, imports: DataFrame, origin: DataFrame) -> DataFrame:
    """file, line, col, pkg, imported, via: references of local names that stand for a package's export, directly or through a file."""
    met = references.join(imports, ["file", "local"])
    direct = met.filter("pkg is not null").select("file", "line", "col", "pkg", "imported", F.lit(None).cast("string").alias("via"))
    through = met.filter("pkg is null and target is not null").select("file", "line", "col", "target", F.col("imported").alias("name"))
    handed = origin.select(F.col("file").alias("target"), "name", F.col("pkg"), F.col("imported"))
    return direct.unionByName(through.join(handed, ["target", "name"]).select("file", "line", "col", "pkg", "imported", F.col("target").alias("via"))).distinct()


def forwarded(re_exports: DataFrame, rounds: int = 64) -> tuple[DataFrame, bool]:
    """file, pkg: packages that a file hands on, itself or through files it hands on; whether `rounds` hops cut it short.

    re_exports: file, target or pkg. Cycles end, as a file is reached once.
    """
    edges = re_exports.filter("target is not null").select(F.col("file").alias("src"), F.col("target").alias("dst")).distinct()
    seen, cut = graphs.closure(edges, re_exports.select(F.col("file").alias("root")).distinct(), rounds)
    own = re_exports.filter("pkg is not null").select(F.col("file").alias("node"), "pkg").distinct()
    return seen.join(own, "node").select(F.col("root").alias("file"), "pkg").distinct(), cut


def public_reexports(entries: DataFrame, forwards: DataFrame) -> DataFrame:
    """pkg, file: packages that a public entry file hands on, which others may then use unseen. entries: file, private boolean."""
    return entries.filter(~F.coalesce("private", F.lit(False))).select("file").distinct().join(forwards, "file").select("pkg", "file").distinct()


def passed_options(references: DataFrame, passed: DataFrame) -> DataFrame:
    """pkg, option, file, line, via: where options are passed: at the call, and where the key is written.

    references: pkg, file, line, col, via; passed: file, line, col (of the call), key, key_line.
    """
    met = references.select("pkg", "file", "line", "col", "via").join(passed, ["file", "line", "col"])
    at = F.array(F.col("line"), F.col("key_line"))
    return met.select("pkg", F.col("key").alias("option"), "file", F.explode(F.array_distinct(at)).alias("line"), "via").distinct()


def used_exports(references: DataFrame, exports: DataFrame) -> DataFrame:
    """pkg, path, file, line: the exports that references reach, in every spelling that the exports have.

    references: pkg, prefix (the entry), binding (named, default, namespace), names array (of the chain, the import
    first), called boolean (the import itself is called before the chain), file, line. exports: pkg, path. One that names
    nothing more precise reaches the module itself.
    """
    rows = graphs.written(references.withColumn("row", F.monotonically_increasing_id()), "references")
    a, b, colon = F.get("names", F.lit(0)), F.get("names", F.lit(1)), F.concat("prefix", F.lit(":"))
    spelled = F.array(
        F.when(~F.col("called"), F.concat(colon, a)),
        F.when(~F.col("called"), F.concat(colon, a, F.lit("#"), b)),
        F.when(~F.col("called"), F.concat(colon, a, F.lit("."), b)),
        F.when(F.col("called"), F.concat(colon, F.lit("#"), a)),
        F.when(F.col("binding") == "default", F.concat(colon, F.lit("default."), a)),
        F.when(F.col("binding") == "default", F.concat(colon, F.lit("default#"), a)),
    )
    own = exports.select("pkg", "path").distinct()
    hit = rows.select("row", "pkg", "file", "line", F.explode(F.array_compact(spelled)).alias("path")).join(own, ["pkg", "path"])
    rest = rows.join(hit.select("row").distinct(), "row", "left_anti")
    whole = rest.select("row", "pkg", "file", "line", F.explode(F.array(colon, F.concat(colon, F.lit("default")))).alias("path")).join(own, ["pkg", "path"])
    return hit.unionByName(whole).select("pkg", "path", "file", "line").distinct()


def tools_used(scripts: DataFrame, binaries: DataFrame) -> DataFrame:
    """pkg, manifest: packages whose commands a script calls. scripts: manifest, script; binaries: pkg, bin."""
    words = scripts.select("manifest", F.explode(F.array_distinct(F.split("script", r"[\s;&|()]+"))).alias("bin")).filter("bin <> ''")
    return words.join(binaries, "bin").select("pkg", "manifest").distinct()


def reach(exports: DataFrame, edges: DataFrame, rounds: int = 64) -> tuple[DataFrame, bool]:
    """root, node, depth of the units that exports may run, unit keys made of pkg, version and unit; whether it was cut."""
    key = lambda u: F.concat_ws("\u0000", "pkg", "version", F.col(u).cast("string"))
    return graphs.closure(edges.select(key("src").alias("src"), key("dst").alias("dst")), exports.select(key("unit").alias("root")).distinct(), rounds)


def changed_exports(before: DataFrame, after: DataFrame) -> DataFrame:
    """pkg, path, names: exports whose reached code differs, and the units in which it does.

    before, after: pkg, path, name, fp: a row for each unit that an export reaches. Multisets of fingerprints by
    unit name are compared as counts, so equal units never gather.
    """
    count = lambda df, c: df.groupBy("pkg", "path", "name", "fp").agg(F.count(F.lit(1)).alias(c))
    met = count(before, "a").join(count(after, "b"), ["pkg", "path", "name", "fp"], "full")
    differing = met.filter(~F.col("a").eqNullSafe(F.col("b"))).select("pkg", "path", "name").distinct()
    both = before.select("pkg", "path").distinct().join(after.select("pkg", "path").distinct(), ["pkg", "path"], "left_semi")
    return differing.join(both, ["pkg", "path"], "left_semi").groupBy("pkg", "path").agg(F.array_sort(F.collect_set("name")).alias("names"))


def changed_share(exports: DataFrame, changed: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """pkg, share: the part of a package's exports that changed inside, or of those in use (pkg, path) if that is more."""

    def of(some: DataFrame) -> DataFrame:
        met = some.select("pkg", "path").distinct().join(changed.select("pkg", "path", F.lit(1).alias("c")).distinct(), ["pkg", "path"], "left")
        return met.groupBy("pkg").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("c")).select("pkg", numbers.share(F.col("c"), F.col("n")).alias("share"))

    every = of(exports)
    return every if used is None else every.unionByName(of(used)).groupBy("pkg").agg(F.max("share").alias("share"))


def hints(unplaced: DataFrame, changed: DataFrame, share: DataFrame, gate: float = 0.25, most: int = 3) -> DataFrame:
    """pkg, entry, path: unplaced notes tied to used exports by a code name that changed inside; over `most` exports say nothing.

    unplaced: pkg, entry, names array. Packages of which more than `gate` changed give no hints, which is decided first.
    """
    quiet = share.filter(F.col("share") <= gate).select("pkg")
    a = unplaced.join(quiet, "pkg", "left_semi").select("pkg", "entry", F.explode("names").alias("name"))
    b = changed.select("pkg", "path", F.explode("names").alias("name"))
    met = a.join(b, ["pkg", "name"]).select("pkg", "entry", "path").distinct()
    few = met.groupBy("pkg", "entry").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return met.join(few, ["pkg", "entry"], "left_semi")


#: Share of changed exports beyond which a hint says nothing.
HINT_SHARE = 0.25


def hint_state(packages: DataFrame, gate: float = HINT_SHARE) -> DataFrame:
    """packages with hint_state (computed, skipped, failed or too-many-changed) and hint_reason: whether unplaced notes are held against changed code, and why not.

    Columns: refs, bump, code_names (how many code names the unplaced notes have), failed (the code of a version could not be
    read), capped (it was cut), usable (exports that the project could use), share (`changed_share`, null if unknown). The first
    gate that closes is the reason; a package's code isn't asked for before those that cost nothing are open.
    """
    reason = (
        F.when(F.coalesce("refs", F.lit(0)) == 0, "no-usage")
        .when(F.col("bump") == "major", "major")
        .when(F.coalesce("code_names", F.lit(0)) == 0, "no-code-names")
        .when(F.coalesce("failed", F.lit(False)), "unread")
        .when(F.coalesce("capped", F.lit(False)), "capped")
        .when(F.coalesce("usable", F.lit(0)) == 0, "no-usable-export")
        .when(F.coalesce("share", F.lit(1.0)) > gate, "too-many-changed")
    )
    state = F.when(F.col("hint_reason").isNull(), "computed").when(F.col("hint_reason") == "unread", "failed").when(F.col("hint_reason") == "too-many-changed", "too-many-changed").otherwise("skipped")
    return packages.withColumn("hint_reason", reason).withColumn("hint_state", state)
