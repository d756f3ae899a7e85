"""Briefs from end to end: candidates, surface, usage, notes and verdict as stages, each a written table a package, joined into one row a package.

Tables of a project (others of their columns aren't read):

* installed: pkg, version, version_source, manifests array<string>, flags array<string>, out_of_sync (a count);
* releases: pkg, version, published_at, deprecated; latest: pkg, latest;
* symbols: pkg, version, path, kind, sig, deprecated, alias_of, returns, instance_of; entries: pkg, version, prefix, external;
* references: what `values.attributed` gives, with type_only and code (the line); opaque: pkg, kind;
* sources: name and table (pkg, version, body, reason) of release notes, in the order in which they are asked.

A stage reads what is written of those before it and loses no package: what isn't known is null and makes a rule fire.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, semver
from . import briefs, chains, entries, graphs, matching, notes, surfaces, verdicts, versions

SITE = ["file", "line", "col", "type_only", "code", "via"]


class Project(NamedTuple):
    installed: DataFrame
    releases: DataFrame
    latest: DataFrame
    symbols: DataFrame
    entries: DataFrame
    references: DataFrame
    opaque: DataFrame
    sources: list[tuple[str, DataFrame]]


class Stages(NamedTuple):
    """What each stage wrote: candidates, surface (a row a package), changes (touched ones, with their sites), usage, names (with
    their sites), coverage, versions (of notes), notes (entries with bucket and names)."""

    candidates: DataFrame
    surface: DataFrame
    changes: DataFrame
    usage: DataFrame
    names: DataFrame
    coverage: DataFrame
    versions: DataFrame
    notes: DataFrame


def candidates(project: Project, now: Column, least_age_days: int) -> DataFrame:
    """pkg, from, to, bump, published_at, held_back, also, and what is known of the installed copy; those up to date have none."""
    found = versions.candidates(project.installed.select("pkg", "version"), project.releases, project.latest, now, least_age_days).filter("target is not null")
    dated = project.releases.groupBy("pkg", F.col("version").alias("target")).agg(F.max("published_at").alias("published_at"))
    known = project.releases.select("pkg", "version", F.lit(True).alias("known")).distinct()
    own = project.installed.select("pkg", "version", "version_source", "manifests", "flags", "out_of_sync").join(known, ["pkg", "version"], "left")
    flags = F.when(F.col("known").isNull(), F.array_union("flags", F.array(F.lit("not-in-registry")))).otherwise(F.col("flags"))
    met = found.join(dated, ["pkg", "target"], "left").join(own.withColumn("flags", flags), ["pkg", "version"])
    return graphs.written(met.select("pkg", F.col("version").alias("from"), F.col("target").alias("to"), "bump", "published_at", "held_back", "also", "version_source", "manifests", "flags", "out_of_sync", "known"), "candidates")


def _effective(refs: DataFrame) -> DataFrame:
    """refs with strong and weak names of their chains, as written: the imported name first, unless it stands for the module."""
    plain = F.transform(F.coalesce("chain", F.array().cast(chains.NONE)), lambda s: F.struct(s["name"].alias("name"), F.coalesce(s["call"], F.lit(False)).alias("call")))
    called = F.coalesce("called", F.lit(False))
    named = (F.col("binding") == "named") & ~(chains.is_short_name(F.col("imported")) & ~called)
    derived = F.col("way") == "derived"
    whole = F.when(named & ~derived, F.concat(F.array(F.struct(F.col("imported").alias("name"), called.alias("call"))), plain)).otherwise(plain)
    whole = F.when((F.size(whole) > 0) & (F.get(whole, F.lit(0))["name"] == "default"), F.slice(whole, 2, F.greatest(F.size(whole) - 1, F.lit(0)))).otherwise(whole)
    rows = refs.withColumns({"whole": whole, "first_called": (F.col("binding") != "named") & called & ~derived, "of_value": derived})
    told = briefs.chain_names(F.col("whole"), F.col("first_called"), F.col("of_value"))
    return rows.withColumn("told", told).select("*", "told.strong", "told.weak").drop("told", "whole", "first_called", "of_value")


def usage(project: Project, cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row a package (refs, files, strong_names, weak_names, blind, opaque), and a row a site of each name."""
    own = project.references.join(cand.select("pkg").distinct(), "pkg", "left_semi")
    seen = _effective(own.filter("blind is null"))
    named = briefs.name_sets(seen.select("pkg", "file", "strong", "weak"))
    blind = own.filter("blind is not null").groupBy("pkg", F.col("blind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    blind = blind.groupBy("pkg").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("blind"))
    told = cand.select("pkg").join(named, "pkg", "left").join(blind, "pkg", "left")
    none = F.array().cast("array<string>")
    told = told.select("pkg", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("strong_names", none).alias("strong_names"), F.coalesce("weak_names", none).alias("weak_names"), F.coalesce("blind", F.array().cast("array<struct<kind:string,n:bigint>>")).alias("blind"))
    hidden = project.opaque.join(cand.select("pkg"), "pkg", "left_semi")
    whole = briefs.with_opaque(told.withColumn("opaque", none), hidden)
    each = seen.select("pkg", F.explode(F.concat("strong", "weak")).alias("name"), *SITE)
    return graphs.written(whole, "usage"), graphs.written(briefs.unique_sites(each, ["pkg", "name"]), "names")


def surface(project: Project, cand: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row a package (state, incomplete, changes, added, unread names), and its touched changes with sites."""
    of = lambda table, version: table.join(cand.select("pkg", F.col(version).alias("version")), ["pkg", "version"]).drop("version")
    before, after = of(project.symbols, "from"), of(project.symbols, "to")
    diffed = surfaces.diff(before, after, of(project.entries, "to"))
    told = graphs.written(surfaces.collapsed(surfaces.without_children(diffed)), "told-changes")
    walked = graphs.written(chains.walk(project.references.filter("blind is null").join(cand.select("pkg"), "pkg", "left_semi"), before, of(project.entries, "from")), "walked")
    site = F.struct(*SITE)
    reach = graphs.written(chains.reached(walked.withColumn("site", site).select("pkg", "site", "paths", "unresolved", "missing_head")), "reached")
    landed = surfaces.touched(reach, told, ["site"]).select("pkg", "path", "bucket", "strength", "site.*")
    sites = briefs.unique_sites(landed, ["pkg", "path", "bucket", "strength"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", *SITE))), lambda s: s.dropFields("place"))
    touched = sites.groupBy("pkg", "path", "bucket", "strength").agg(listed.alias("sites"))
    touched = graphs.written(touched.join(told.select("pkg", "path", "bucket", "before", "after", "also_at"), ["pkg", "path", "bucket"]), "touched")
    counts = told.groupBy("pkg").agg(F.count_if(F.col("bucket").isin("removed", "changed", "deprecated")).alias("changes"), F.count_if(F.col("bucket") == "added").alias("added"))
    doubt = surfaces.in_doubt(reach, told).groupBy("pkg").agg(F.sum("n").alias("unproven"), F.array_sort(F.collect_list(F.struct("cause", "n"))).alias("causes"))
    unread = walked.groupBy("pkg").agg(F.count_if("missing_head").alias("unread"))
    typed = project.symbols.select("pkg", "version").distinct()
    has = cand.select("pkg", "from", "to", "known").join(typed.withColumnRenamed("version", "from").withColumn("a", F.lit(True)), ["pkg", "from"], "left").join(typed.withColumnRenamed("version", "to").withColumn("b", F.lit(True)), ["pkg", "to"], "left")
    types = project.installed.select(F.col("pkg").alias("types_pkg")).distinct()
    has = has.withColumn("types_pkg", paths.types_package(F.col("pkg"))).join(types.withColumn("types_package", F.lit(True)), "types_pkg", "left")
    state = has.join(used.select("pkg", "refs"), "pkg").join(doubt, "pkg", "left").join(counts, "pkg", "left").join(unread, "pkg", "left")
    state = state.withColumns({"missing": F.col("known").isNull(), "has_types": F.coalesce(F.col("a") & F.col("b"), F.lit(False))})
    whole = briefs.surface_state(state).select("pkg", "surface", "incomplete", F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("unproven", F.lit(0)).alias("unproven"), "causes", F.when(F.col("surface") == "computed", F.coalesce("unread", F.lit(0))).otherwise(0).alias("unread"))
    whole = graphs.written(whole, "surface")
    graphs.dropped(told, walked, reach)
    # nothing is touched in what wasn't compared
    computed = whole.filter("surface = 'computed'").select("pkg")
    return whole, touched.join(computed, "pkg", "left_semi")


def read_notes(project: Project, cand: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coverage a package, where each version's notes come from, and the entries with bucket and the names that they have."""
    span = project.releases.join(cand.select("pkg", "from", "to"), "pkg").filter(semver.between("version", "from", "to")).select("pkg", "version").distinct()
    wanted = graphs.written(span, "versions")
    read = graphs.written(notes.waterfall(wanted, project.sources), "notes")
    ranges = cand.select("pkg").join(wanted, "pkg", "left")
    covered = notes.coverage(ranges, read)
    split = entries.split(read.filter("body is not null"), "pkg", "version", "body").withColumn("id", F.concat_ws("\u0000", F.col("pkg").cast("string"), "id"))
    split = graphs.written(split, "note-entries")
    names = used.select("pkg", F.explode(F.concat(F.transform("strong_names", lambda n: F.struct(n.alias("name"), F.lit("strong").alias("strength"))), F.transform("weak_names", lambda n: F.struct(n.alias("name"), F.lit("weak").alias("strength"))))).alias("n")).select("pkg", "n.*")
    names = graphs.written(names, "used-names")
    ruled = matching.rules(split).drop("version", "title").join(split.select(F.col("id").alias("entry"), "pkg", "version", "title", "refs", "ord"), "entry")
    ruled = graphs.written(ruled, "ruled-entries")
    regions = matching.region_rows(split, notes.pointed(split.withColumn("version", F.concat_ws("\u0000", F.col("pkg").cast("string"), "version"))))
    regions = graphs.written(regions, "regions")
    found = graphs.written(matching.mentions(regions, names).unionByName(matching.scoped(ruled, names)), "found")
    of_pkg = ruled.select("entry", "pkg")
    often = matching.demoted(found.join(of_pkg, "entry"), regions.join(of_pkg, "entry"), by=["pkg"])
    hit = matching.hits(found, names, ruled, often.select("pkg", "name"), by=["pkg"])
    bucketed = matching.buckets(ruled, hit)
    shown = hit.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("name", "strength", "region"))).alias("names"))
    none = F.array().cast("array<struct<name:string,strength:string,region:string>>")
    whole = bucketed.join(shown, "entry", "left").withColumn("names", F.coalesce("names", none))
    out = graphs.written(covered, "coverage"), read, graphs.written(whole.select("pkg", "version", "ord", "title", "refs", "breaking", "direct", "bucket", "names"), "bucketed-notes")
    graphs.dropped(wanted, split, names, ruled, regions, found)
    return out


def stages(project: Project, now: Column, least_age_days: int) -> Stages:
    """All stages, in the order in which each needs those before it."""
    cand = candidates(project, now, least_age_days)
    used, names = usage(project, cand)
    state, changes = surface(project, cand, used)
    covered, read, told = read_notes(project, cand, used)
    return Stages(cand, state, changes, used, names, covered, read, told)


def judged(s: Stages) -> DataFrame:
    """A row a package: its counts and states, reasons and verdict."""
    strong = F.col("strength") == "strong"
    hit = s.changes.groupBy("pkg").agg(*[F.count_if((F.col("bucket") == b) & strong).alias(b) for b in ("removed", "changed", "deprecated")], F.count_if(~strong).alias("weak"))
    said = s.notes.groupBy("pkg").agg(F.count_if(F.col("bucket") == "matched").alias("matched"), F.count_if(F.col("bucket") == "unattributed-breaking").alias("unattributed_breaking"), F.count_if(F.col("bucket") == "unattributed-change").alias("unattributed_change"), F.count(F.lit(1)).alias("entries"))
    rows = s.candidates.join(s.surface, "pkg").join(s.usage.select("pkg", "refs", "files", F.size("opaque").alias("opaque"), F.size("blind").alias("n_blind")), "pkg").join(hit, "pkg", "left").join(said, "pkg", "left")
    rows = rows.join(s.coverage.select("pkg", F.col("coverage").alias("notes")), "pkg", "left")
    counts = ["removed", "changed", "deprecated", "weak", "matched", "unattributed_breaking", "unattributed_change", "entries", "out_of_sync"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"notes": F.coalesce("notes", F.lit("unavailable"))})
    flagged = F.size(F.filter("flags", lambda f: f.isin("not-in-registry", "patched", "range-guess")))
    return verdicts.decide(rows.withColumns({"flagged": flagged, "blind": F.col("n_blind") + (F.col("unread") > 0).cast("int")}))


def _site(s: Column) -> Column:
    """A site as the document has it; a missing `via` is absent."""
    return F.struct(s["file"].alias("file"), s["line"].alias("line"), s["col"].alias("column"), s["type_only"].alias("typeOnly"), s["code"].alias("code"), F.when(s["via"].isNotNull(), F.array(s["via"])).alias("via"))


def _certainty(strength: Column) -> Column:
    return F.when(strength == "strong", "exact").otherwise("by-name")


def _details() -> Column:
    """What a reason counts, or the state that it names, by its code."""
    counted = {"removed-touched": "removed", "changed-touched": "changed", "deprecated-touched": "deprecated", "possibly-touched": "weak", "notes-match": "matched", "unattributed-breaking": "unattributed_breaking", "unattributed-change": "unattributed_change", "blind-spots": "blind", "opaque-usage": "opaque", "flagged-install": "flagged", "out-of-sync": "out_of_sync"}
    states = {"surface-incomplete": ["surface"], "no-evidence": ["notes", "surface"], "major-unproven": ["bump"]}
    pairs = [(code, F.col(c).cast("string")) for code, c in counted.items()] + [(code, F.concat_ws(", ", *cs)) for code, cs in states.items()]
    return F.create_map(*[x for code, told in pairs for x in (F.lit(code), told)])


def _listed(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """pkg and an array of value, in order."""
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("x"))
    return rows.groupBy("pkg").agg(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["x"]).alias(name))


def documents(s: Stages) -> DataFrame:
    """pkg and document: a struct a package, in the fields of the JSON contract's version 1, lists in their order.

    What isn't known is null, and absent as JSON; empty lists stay. A document is what a reader of its package gets,
    and as large as what was found of it.
    """
    told = judged(s)
    changed = s.changes.withColumn("rank", F.when(F.col("bucket") == "removed", 0).when(F.col("bucket") == "changed", 2).otherwise(4) + F.when(F.col("strength") == "weak", 1).otherwise(0))
    touched = _listed(changed, [F.col("rank"), F.col("path")], F.struct(F.col("path"), F.col("also_at").alias("alsoAt"), F.col("bucket").alias("change"), _certainty(F.col("strength")).alias("certainty"), F.col("before"), F.col("after"), F.transform("sites", _site).alias("sites")), "touched")
    by_version = [semver.version_order("version"), F.col("ord")]
    matched = _listed(
        s.notes.filter("bucket = 'matched'"), [~F.col("breaking"), ~F.col("direct"), *by_version],
        F.struct("version", "title", "breaking", "direct", "refs", F.transform("names", lambda n: F.struct(n["name"].alias("name"), _certainty(n["strength"]).alias("certainty"), n["region"].alias("where"))).alias("names")), "matched_notes",
    )
    unplaced = lambda bucket, name: _listed(s.notes.filter(F.col("bucket") == bucket), by_version, F.struct("version", "title", "refs"), name)
    read = _listed(s.versions, [semver.version_order("version")], F.struct("version", F.when(F.col("found_in").isNotNull(), "found").otherwise("missing").alias("status"), F.when(F.col("found_in").isNotNull(), F.struct(F.col("found_in").alias("kind"))).alias("source"), F.col("reason")), "per_version")
    sites = s.names.groupBy("pkg", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *SITE))), lambda x: _site(x)).alias("sites"))
    by_name = sites.groupBy("pkg").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "sites")))).alias("by_name"))
    rows = told
    for some in (touched, matched, unplaced("unattributed-breaking", "no_api_breaking"), unplaced("unattributed-change", "no_api_change"), read, by_name, s.usage.select("pkg", "strong_names", "weak_names", F.col("blind").alias("blind_kinds"), F.col("opaque").alias("opaque_kinds"))):
        rows = rows.join(some, "pkg", "left")
    schema = rows.schema
    lists = lambda c: F.coalesce(F.col(c), F.array().cast(schema[c].dataType))
    hidden = F.concat(F.transform("opaque_kinds", lambda k: F.struct(k.alias("kind"), F.lit(1).cast("long").alias("count"))), F.transform("blind_kinds", lambda b: F.struct(b["kind"].alias("kind"), b["n"].alias("count"))), F.when(F.col("unread") > 0, F.array(F.struct(F.lit("unresolved-against-surface").alias("kind"), F.col("unread").alias("count")))).otherwise(F.array().cast("array<struct<kind:string,count:bigint>>")))
    computed = F.col("surface") == "computed"
    document = F.struct(
        F.col("pkg").cast("string").alias("name"), F.col("from"), F.col("to"), F.col("bump"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.col("verdict"),
        F.transform("reasons", lambda c: F.struct(c.alias("code"), F.coalesce(_details()[c], F.lit("")).alias("detail"))).alias("reasons"), F.col("version_source").alias("versionSource"), F.array_sort("manifests").alias("manifests"),
        F.struct(F.col("surface").alias("status"), F.when(F.col("incomplete"), F.array_join(F.transform("causes", lambda c: F.concat(c["n"].cast("string"), F.lit(" "), c["cause"])), ", ")).alias("detail"), F.when(computed, F.col("changes")).alias("changes"), F.when(computed, F.col("added")).alias("added"), lists("touched").alias("touched")).alias("types"),
        F.struct(F.col("notes").alias("coverage"), F.col("entries"), lists("per_version").alias("versions"), lists("matched_notes").alias("matched"), lists("no_api_breaking").alias("breakingWithoutApi"), lists("no_api_change").alias("changesWithoutApi")).alias("notes"),
        F.struct(F.col("files"), F.col("refs").alias("sites"), F.struct(F.col("strong_names").alias("exact"), F.col("weak_names").alias("byName")).alias("names"), F.coalesce("by_name", F.create_map().cast(schema["by_name"].dataType)).alias("sitesByName"), hidden.alias("cannotSee")).alias("usage"),
        F.transform("held_back", lambda h: F.struct(h["version"].alias("version"), h["reason"].alias("reason"))).alias("heldBack"),
        F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("version"), semver.bump("from", "also").alias("bump"))).alias("alsoAvailable"),
    )
    return rows.select("pkg", document.alias("document"))


def brief(project: Project, now: Column, least_age_days: int = 7) -> DataFrame:
    """A row a package with an update: pkg, verdict and its document as JSON."""
    found = documents(stages(project, now, least_age_days))
    return found.select("pkg", F.col("document.verdict").alias("verdict"), F.to_json("document").alias("json"))
