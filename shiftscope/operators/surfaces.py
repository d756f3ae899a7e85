"""Exported surfaces of two versions compared.

Tables, one row a symbol of one version:

* symbols: pkg, path, kind string, sig array<string>, deprecated boolean, alias_of string and, where known,
  unresolved_base boolean (a class whose base could not be read);
* entries: pkg, prefix (a path's part before the colon), external array<string> (packages it hands on unread);
* flags: pkg, flag (symbol-cap, wildcard-truncated, external-types-unresolved) of the new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, signatures
from . import graphs

ALIAS_HOPS = 5


def same_multiset(a: Column, b: Column) -> Column:
    return F.sort_array(a) == F.sort_array(b)


def dereferenced(symbols: DataFrame) -> DataFrame:
    """symbols whose sig is that of what their alias chain ends at, at most ALIAS_HOPS away; cut: whether a chain goes on."""
    if symbols.filter("alias_of is not null").isEmpty():
        return symbols.withColumn("cut", F.lit(False))
    known = symbols.select("pkg", F.col("path").alias("to"), F.col("sig").alias("to_sig"), F.col("alias_of").alias("beyond"))
    out = symbols.withColumn("at", F.col("alias_of"))
    for _ in range(ALIAS_HOPS):
        met = out.withColumnRenamed("at", "to").join(known, ["pkg", "to"], "left")
        out = met.withColumns({"sig": F.coalesce("to_sig", "sig"), "at": F.when(F.col("to_sig").isNotNull(), F.col("beyond"))}).drop("to", "to_sig", "beyond")
    return out.withColumn("cut", F.col("at").isNotNull()).drop("at")


def _prefixes(path: Column) -> Column:
    """A path and all above it, the longest first, each with what is left of the path behind it."""
    every = F.reverse(F.array_append(paths.ancestors(path), path))
    return F.transform(every, lambda p: F.struct(p.alias("up"), F.substr(path, F.length(p) + 1).alias("rest")))


def resolved_in(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """pkg, path, found: the symbol of another surface that a path stands for there, itself or through an alias of a prefix.

    Of a path that isn't there the longest prefix with an alias is followed, at most ALIAS_HOPS times.
    """
    names = symbols.select("pkg", F.col("path").alias("at"), "alias_of")
    open_ = wanted.select("pkg", "path", F.col("path").alias("at")).distinct()
    done = open_.join(names.select("pkg", "at"), ["pkg", "at"], "left_semi").select("pkg", "path", F.col("at").alias("found"))
    if names.filter("alias_of is not null").isEmpty():
        return done
    open_, names = graphs.written(open_, "paths"), graphs.written(names, "symbols")
    for hop in range(ALIAS_HOPS + 1):
        there = open_.join(names.select("pkg", "at"), ["pkg", "at"], "left_semi").select("pkg", "path", F.col("at").alias("found"))
        done = there if hop == 0 else done.unionByName(there)
        left = open_.join(names.select("pkg", "at"), ["pkg", "at"], "left_anti").select("pkg", "path", F.col("at").alias("whole"))
        each = left.select("pkg", "path", "whole", F.posexplode(_prefixes(F.col("whole"))).alias("far", "x")).filter("far > 0")
        met = each.select("pkg", "path", "far", F.col("x.up").alias("at"), "x.rest").join(names.filter("alias_of is not null"), ["pkg", "at"])
        open_ = graphs.written(met.groupBy("pkg", "path").agg(F.min_by(F.concat("alias_of", "rest"), "far").alias("at")), "paths")
        if open_.isEmpty():
            break
    return done


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """pkg, path, found: old paths and the new surface's symbol that each stands for, under its own name, through an alias
    of the new surface, or under another name that the old surface had for it."""
    own = before.select("pkg", "path").distinct()
    found = graphs.written(resolved_in(own, after), "moved")
    gone = own.join(found, ["pkg", "path"], "left_anti")
    alias = before.filter("alias_of is not null").select("pkg", F.col("alias_of").alias("up"), F.col("path").alias("alias"))
    if alias.isEmpty():
        return found
    each = gone.select("pkg", "path", F.posexplode(_prefixes(F.col("path"))).alias("far", "x")).select("pkg", "path", "far", F.col("x.up").alias("up"), "x.rest")
    other = graphs.written(each.join(alias, ["pkg", "up"]).select("pkg", F.col("path").alias("from"), "far", "alias", F.concat("alias", "rest").alias("path")), "other-names")
    there = other.join(resolved_in(other, after), ["pkg", "path"])
    best = there.groupBy("pkg", F.col("from").alias("path")).agg(F.min_by("found", F.struct("far", "alias")).alias("found"))
    return found.unionByName(best)


def unproven_cause(gone: DataFrame, after: DataFrame, entries: DataFrame | None, flags: DataFrame | None) -> DataFrame:
    """pkg, path, cause: why a path missing from the new surface may still be there; only paths with a cause.

    In order: a class above it has a base that wasn't read, its entry hands on another package, the surface was cut, its
    entry was one of too many.
    """
    prefix = F.regexp_extract("path", r"^([^:]*):", 1)
    rows = gone.select("pkg", "path", prefix.alias("prefix")).distinct()
    based = after.filter("unresolved_base") if "unresolved_base" in after.columns else after.filter("false")
    above = rows.select("pkg", "path", F.explode(paths.ancestors(F.col("path"))).alias("up")).join(based.select("pkg", F.col("path").alias("up")), ["pkg", "up"], "left_semi")
    out = rows.join(above.select("pkg", "path").distinct().withColumn("base", F.lit(True)), ["pkg", "path"], "left")
    if entries is not None:
        out = out.join(entries.select("pkg", "prefix", (F.size(F.coalesce("external", F.array().cast("array<string>"))) > 0).alias("external"), F.lit(True).alias("entry")), ["pkg", "prefix"], "left")
    else:
        out = out.withColumns({"external": F.lit(False), "entry": F.lit(True)})
    if flags is not None:
        out = out.join(flags.groupBy("pkg").agg(F.collect_set("flag").alias("flags")), "pkg", "left")
    else:
        out = out.withColumn("flags", F.array().cast("array<string>"))
    has = lambda x: F.coalesce(F.array_contains("flags", x), F.lit(False))
    cause = (
        F.when(F.col("base"), "unresolved-base")
        .when(F.col("external"), "external-reexport")
        .when(has("symbol-cap"), "symbol-cap")
        .when(F.col("entry").isNull() & has("wildcard-truncated"), "subpath-cap")
    )
    return out.select("pkg", "path", cause.alias("cause")).filter("cause is not null")


def diff(before: DataFrame, after: DataFrame, entries: DataFrame | None = None, flags: DataFrame | None = None, lenient: bool = False) -> DataFrame:
    """pkg, path, kind, bucket (removed, unproven, changed, widened, deprecated, added), before, after, cause, from_param.

    entries and flags are the new version's. A path that only moved isn't removed, one that may still be there is
    unproven. lenient: signatures alike but for `any` are the same. from_param: the first parameter in which a changed
    one differs, where nothing before it does.
    """
    named = before.filter("alias_of is not null").isEmpty() and after.filter("alias_of is not null").isEmpty()
    doubts = entries is not None or flags is not None or "unresolved_base" in after.columns
    own = lambda df: df.select("pkg", "path", F.col("kind").alias("a_kind"), F.col("sig").alias("before"), F.coalesce("deprecated", F.lit(False)).alias("a_old"), F.col("alias_of").isNotNull().alias("aliased"))
    new = lambda df, path: df.select("pkg", F.col("path").alias(path), F.col("kind").alias("b_kind"), F.col("sig").alias("after"), F.coalesce("deprecated", F.lit(False)).alias("b_old"))
    if named:
        # no name stands for another: both sides meet once
        met = own(before).join(new(after, "path"), ["pkg", "path"], "full")
    else:
        before, after = graphs.written(before, "symbols"), graphs.written(after, "symbols")
        latest = dereferenced(after)
        place = moved(before, after)
        gained = new(latest, "path").join(before.select("pkg", "path"), ["pkg", "path"], "left_anti")
        met = own(dereferenced(before)).join(place, ["pkg", "path"], "left").join(new(latest, "found"), ["pkg", "found"], "left").drop("found")
        met = met.unionByName(gained, allowMissingColumns=True)
    gains = (F.size("before") == 0) & F.col("a_kind").isin("namespace", "interface")
    same = same_multiset(F.col("before"), F.col("after"))
    if lenient:
        same = same | signatures.same_modulo_any(F.col("before"), F.col("after"))
    bucket = (
        F.when(F.col("a_kind").isNull(), "added")
        .when(F.col("b_kind").isNull(), "removed")
        .when((F.col("a_kind") == "namespace") & (F.col("b_kind") == "namespace"), None)
        .when(~same, F.when(gains | signatures.is_widening(F.col("before"), F.col("after")), "widened").otherwise("changed"))
        .when(~F.col("a_old") & F.col("b_old") & ~F.col("aliased"), "deprecated")
    )
    told = met.select("pkg", "path", F.coalesce("b_kind", "a_kind").alias("kind"), bucket.alias("bucket"), "before", "after").filter("bucket is not null")
    cause = F.lit(None).cast("string").alias("cause")
    if doubts:
        told = graphs.written(told, "changes")
        causes = unproven_cause(told.filter("bucket = 'removed'"), after, entries, flags)
        told = told.join(causes, ["pkg", "path"], "left").withColumn("bucket", F.when((F.col("bucket") == "removed") & F.col("cause").isNotNull(), "unproven").otherwise(F.col("bucket")))
        cause = F.col("cause")
    param = F.when(F.col("bucket") == "changed", signatures.first_changed_parameter(F.col("before"), F.col("after")))
    return told.select("pkg", "path", "kind", "bucket", "before", "after", cause, param.alias("from_param"))


def without_children(changes: DataFrame) -> DataFrame:
    """Removed, unproven and added symbols whose ancestor went or came too are left out: the ancestor tells it."""
    changes = graphs.written(changes, "changes")  # read three times
    whole = changes.filter(F.col("bucket").isin("removed", "unproven", "added"))
    roots = whole.select("pkg", "bucket", F.col("path").alias("above")).distinct()
    under = whole.select("pkg", "bucket", "path", F.explode(paths.ancestors(F.col("path"))).alias("above")).join(roots, ["pkg", "bucket", "above"], "left_semi")
    return changes.join(under.select("pkg", "bucket", "path").distinct(), ["pkg", "bucket", "path"], "left_anti")


def collapsed(changes: DataFrame) -> DataFrame:
    """One row for a change seen at many paths: the best ranked path, the others in also_at. Unproven ones stay as they are."""
    own = changes.withColumns({"name": F.element_at(paths.segments(F.col("path")), -1), "seen": F.struct(paths.path_rank(F.col("path")).alias("rank"), F.col("path").alias("path"))})
    told = own.columns
    param = F.min("from_param") if "from_param" in told else F.lit(None).cast("int")
    alone = F.when(F.col("bucket") == "unproven", F.col("path"))
    group = own.groupBy("pkg", "bucket", "kind", "name", "before", "after", alone.alias("alone")).agg(F.array_sort(F.collect_set("seen")).alias("seen"), param.alias("from_param"), *([F.min("cause").alias("cause")] if "cause" in told else []))
    others = F.transform(F.slice("seen", 2, F.greatest(F.size("seen") - 1, F.lit(1))), lambda s: s["path"])
    cause = ["cause"] if "cause" in told else []
    return group.select("pkg", F.col("seen")[0]["path"].alias("path"), "kind", "bucket", "before", "after", F.when(F.size("seen") > 1, others).otherwise(F.array().cast("array<string>")).alias("also_at"), "from_param", *cause)


def _landed(refs: DataFrame, changes: DataFrame, buckets: list[str], others: list[str]) -> DataFrame:
    """pkg, path, bucket, cause, ref, strength and the refs' others: the uses on which changes of these buckets land."""
    args = F.col("args").cast("int") if "args" in refs.columns else F.lit(None).cast("int")
    param = F.col("from_param") if "from_param" in changes.columns else F.lit(None).cast("int")
    cause = F.col("cause") if "cause" in changes.columns else F.lit(None).cast("string")
    rows = refs.select("pkg", "ref", "weak_name", args.alias("args"), *others)
    places = F.array_append(F.col("also_at"), F.col("path")) if "also_at" in changes.columns else F.array("path")
    lands = changes.filter(F.col("bucket").isin(buckets)).select("pkg", "path", "bucket", cause.alias("cause"), param.alias("from_param"), F.explode(places).alias("at"))
    out = ["pkg", "path", "bucket", "cause", "ref", *others]
    exact = rows.join(lands.withColumnRenamed("at", "ref"), ["pkg", "ref"]).filter(F.col("from_param").isNull() | F.col("args").isNull() | (F.col("args") > F.col("from_param"))).select(*out)
    above = rows.select("pkg", "ref", *others, F.explode(paths.ancestors(F.col("ref"))).alias("at"))
    gone = above.join(lands.filter(F.col("bucket").isin("removed", "unproven")), ["pkg", "at"]).select(*out)
    strong = exact.unionByName(gone).distinct()
    named = lands.filter(F.col("at").rlike(r"#[^.#:]+\z")).select("pkg", "path", "bucket", "cause", paths.last_name(F.col("path")).alias("weak_name")).distinct()
    weak = rows.filter("weak_name is not null").join(named, ["pkg", "weak_name"]).select(*out).distinct().join(strong.select("pkg", "path", "bucket").distinct(), ["pkg", "path", "bucket"], "left_anti")
    return strong.withColumn("strength", F.lit("strong")).unionByName(weak.withColumn("strength", F.lit("weak")))


def touched(refs: DataFrame, changes: DataFrame, others: list[str] | None = None) -> DataFrame:
    """pkg, path (of the change), bucket (removed, changed or deprecated), ref, strength: uses that a change lands on.

    refs: pkg, ref (a symbol path), weak_name (a member's name only, or null) and, where known, args (a call's arguments).
    Strong: the change is at the path, or at one above it if it was removed; a call that ends before the first changed
    parameter sees the old signature. Weak: the last names agree, the change is of a member, and nothing strong was found.
    What is unproven lands nowhere: `in_doubt` counts it. others: columns of refs, such as a site, that come through.
    """
    return _landed(refs, changes, ["removed", "changed", "deprecated"], others or []).drop("cause")


def in_doubt(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """pkg, cause, n: paths in use, by name or under them, that the new surface could not have shown: a reason to look, never a removal."""
    met = _landed(refs, changes, ["unproven"], []).select("pkg", "path", "cause").distinct()
    return met.groupBy("pkg", "cause").agg(F.count(F.lit(1)).alias("n"))


def touched_order() -> list[Column]:
    """Removed, changed, deprecated; the strong before the weak of each; then by path."""
    rank = F.when(F.col("bucket") == "removed", 0).when(F.col("bucket") == "changed", 2).otherwise(4)
    return [rank + F.when(F.col("strength") == "weak", 1).otherwise(0), F.asc("path")]
