"""The operators over the driver's tables: each query reads whole tables and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, paths, semver
from ..functions import text as T
from ..operators import assembly, briefs, chains, entries, graphs, history, lines, matching, notes, scoring, surfaces, usage, values, verdicts, versions
from ..sources import installed, manifests, settings

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, strength: every code-shaped token of the pages stands for a name in use."""
    token = table(spark, sf_dir, "pages").select(F.explode(F.array_distinct(matching.tokens(F.col("html")))).alias("name"))
    often = token.filter(T.is_code_shaped(F.col("name")) & (F.length("name") > 2)).distinct()
    return graphs.written(often.select("name", F.lit("strong").alias("strength")), "names")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry"), F.lit(0).alias("ord"), F.lit("prose").alias("kind"), "text")


def name_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.mentions(_regions(spark, sf_dir), _names(spark, sf_dir))
    return found.select(F.col("entry").alias("doc_id"), "name")


def df_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that too many of a language's documents have, each document read as an example."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null").select("lang", F.col("doc_id").alias("entry"), F.lit("code-block").alias("kind"), "text")
    found = docs.select("lang", "entry", "kind", F.explode(F.array_distinct(matching.tokens(F.col("text")))).alias("name"))
    return matching.demoted(found, docs, by=["lang"]).select("lang", "name", F.col("n").alias("df"), F.col("total").alias("n_docs"))


def match_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of all kinds, a quarter of them examples, against names in use, strong or weak: what each is tied to."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = F.coalesce("n_chars", F.lit(0))
    kind = F.when(n % 7 == 0, "housekeeping").when(n % 5 == 0, "addition").otherwise("change")
    told = docs.join(toxic, "doc_id", "left").select(F.col("doc_id").alias("entry"), kind.alias("kind"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("breaking"), F.when(n % 3 == 0, "headline").otherwise("none").alias("names_api"))
    names = _names(spark, sf_dir).withColumn("strength", F.when(F.length("name") % 2 == 0, "strong").otherwise("weak"))
    regions = _regions(spark, sf_dir).withColumn("kind", F.when(F.col("entry") % 4 == 0, "code-block").otherwise("prose"))
    found = graphs.written(matching.mentions(regions, names), "found")
    often = matching.demoted(found, regions, part=0.02)
    out = matching.buckets(told, matching.hits(found, names, told, often))
    return out.select(F.col("entry").alias("doc_id"), "breaking", F.col("n_hits").cast("long").alias("n_hits"), "direct", "bucket")


#: Starts of titles, one for each order by its key.
STARTS = ["fix:", "chore:", "feat(core):", "Add `x` to", "BREAKING CHANGE:", "types:", "docs(readme):", "See the migration guide", "bump a from 1 to 2", "perf:", "[meta] x", "improve typing of", "#12 fix(parser):", "**docs:** about", "Thanks to", "`call()` now", "non-breaking:"]


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, title: orders read as the first lines of notes."""
    start = F.get(F.array(*map(F.lit, STARTS)), (F.col("o_orderkey") % len(STARTS)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", start, F.col("o_orderpriority"), F.lit("of state"), F.col("o_orderstatus")).alias("title"))


def entry_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir).withColumns({"regions": T.text_regions(F.col("title"), "title"), "path": F.array().cast("array<string>")})
    return titles.select("o_orderkey", T.entry_kind(F.col("title"), F.col("title"), F.col("regions"), F.col("path"), F.lit(False)).alias("kind"), T.is_breaking(F.col("title"), F.col("path")).alias("breaking"), T.names_api(F.col("regions")).alias("names_api"))


def title_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope of each title, and whether the rest of it names another API."""
    titles = _titles(spark, sf_dir).withColumns({"regions": T.text_regions(F.col("title"), "title"), "scope": T.commit_scope(F.col("title"))})
    return titles.select("o_orderkey", "scope", T.names_another_api(F.col("title"), F.col("regions"), F.coalesce("scope", F.lit(""))).alias("another"), F.array_join(T.code_names(F.col("title"), F.col("regions")), ",").alias("names"))


def entry_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("regions", T.text_regions(F.coalesce("text", F.lit("")), "prose"))
    spans = F.size(F.filter("regions", lambda r: r["kind"] == "inline-code")).cast("long")
    return docs.select("doc_id", F.size("regions").cast("long").alias("n_regions"), spans.alias("n_code"), F.concat_ws(",", T.references(F.coalesce("text", F.lit("")))).alias("refs"), F.concat_ws(",", T.code_names(F.lit(""), F.col("regions"))).alias("names"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.cleaned(T.prepared(F.col("html"))).alias("text"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.url_host(url).alias("host"), paths.url_path(url).alias("path"), F.size(F.filter(F.split(paths.url_path(url), "/"), lambda p: p != "")).cast("long").alias("depth"))


def fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", lines.fence_counts(F.coalesce("text", F.lit(""))).alias("f")).select("doc_id", F.col("f.lines").alias("n_lines"), F.col("f.fenced").alias("n_fenced"))


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.runs(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linenumber")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, version, body: a customer's orders as the lines of a release's notes, each of a kind by its key."""
    key, word = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    said = [F.concat(F.lit("## part "), word), F.concat(F.lit("- order number "), key), F.concat(F.lit("plain text of "), key), F.lit(""), F.concat(F.lit("  nested under "), key), F.lit("```"), F.concat(F.lit("1. step number "), key)]
    line = F.get(F.array(*said), (F.col("o_orderkey") % len(said)).cast("int"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    return rows.select("o_custkey", F.lit("1.0.0").alias("version"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def split_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entries.split(_bodies(spark, sf_dir), "o_custkey", "version", "body")
    return found.select("o_custkey", F.col("ord").cast("long").alias("ord"), "title", F.array_join("heading_path", "/").alias("path"), F.array_join(F.transform("regions", lambda r: r["kind"]), ",").alias("regions"), "kind")


def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pkg, version, published_at, deprecated: orders read as releases of a customer's package."""
    d = F.col("o_orderdate")
    version = F.concat_ws(".", (F.year(d) - 1995).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pkg"), version.alias("version"), d.cast("timestamp").alias("published_at"), (F.col("o_orderstatus") == "P").alias("deprecated"))
    return rows.groupBy("pkg", "version").agg(F.min("published_at").alias("published_at"), F.bool_or("deprecated").alias("deprecated"))


def candidate_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = _released(spark, sf_dir)
    first = released.groupBy("pkg").agg(F.min_by("version", semver.key("version")).alias("version"))
    latest = released.groupBy("pkg").agg(F.max_by("version", "published_at").alias("latest"))
    found = versions.candidates(first, released, latest, F.lit("2001-09-01").cast("timestamp"), 180)
    return found.select("pkg", "version", "target", "bump", F.concat_ws(",", F.transform("held_back", lambda h: F.concat_ws(":", h["version"], h["reason"]))).alias("held_back"), "also")


def semver_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions.newest_per(_released(spark, sf_dir), ["pkg"], [semver.key("version").desc()], 5)
    return found.select("pkg", "version", F.col("rank").cast("long").alias("rank"))


def bump_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("pkg").orderBy(semver.key("version"))
    steps = _released(spark, sf_dir).withColumn("from", F.lag("version").over(by)).filter("from is not null")
    return steps.groupBy(semver.bump("from", "version").alias("bump")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pkg").alias("packages"))


def range_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = ["^1.2.0", "~2.3", ">=0.5.0 <2.1.0", "1.4 - 3", "4.x || 0.1.x", "*"]
    rows = _released(spark, sf_dir).select("version").distinct().select("version", F.explode(F.array(*map(F.lit, declared))).alias("declared"))
    return rows.filter(semver.satisfies("version", "declared")).groupBy("declared").agg(F.count(F.lit(1)).alias("n"), F.max_by("version", semver.key("version")).alias("highest"))


def snapshot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    version = F.concat_ws(".", F.month(d).cast("string"), F.dayofmonth(d).cast("string"), F.lit("0"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("manifest"), F.col("o_orderstatus").alias("key"), version.alias("version"), (d < F.lit("1998-01-01").cast("timestamp_ntz")).alias("base"))
    return versions.plan(rows.filter("not base").drop("base").distinct(), rows.filter("base").drop("base"))


def _symbols(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Lineitems of one time read as a package's symbols: parts as classes, their suppliers as members."""
    day = F.lit("1998-05-24").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= day if late else F.col("l_shipdate") < day)
    part = F.concat(F.lit("lib:p"), F.col("l_partkey").cast("string"))
    sig = F.array_sort(F.collect_set(F.col("l_quantity").cast("int").cast("string")))
    member = rows.groupBy(F.concat(part, F.lit("#s"), F.col("l_suppkey").cast("string")).alias("path")).agg(sig.alias("sig"), F.bool_or(F.col("l_returnflag") == "R").alias("deprecated"))
    owner = rows.select(part.alias("path")).distinct().select("path", F.array().cast("array<string>").alias("sig"), F.lit(False).alias("deprecated"))
    both = member.withColumn("kind", F.lit("method")).unionByName(owner.withColumn("kind", F.lit("class")))
    return both.withColumns({"pkg": F.lit("lib"), "alias_of": F.lit(None).cast("string")})


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.diff(_symbols(spark, sf_dir, False), _symbols(spark, sf_dir, True))


def surface_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("path", "kind", "bucket", F.concat_ws(",", "before").alias("before"), F.concat_ws(",", "after").alias("after"))


def drop_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.without_children(_changes(spark, sf_dir)).select("path", "kind", "bucket")


def collapse_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.collapsed(surfaces.without_children(_changes(spark, sf_dir))).select("path", "kind", "bucket", F.size("also_at").cast("long").alias("n_also"))


def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(paths.url_host(F.col("url")), paths.url_path(F.col("url"))).alias("path"))
    shared = pages.select(F.explode(paths.folders(F.col("path"))).alias("prefix")).filter("prefix <> ''").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return graphs.longest_prefix(pages, shared, paths.folders).select(F.col("id").alias("page_id"), "path", "prefix")


def followup_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type")
    found = lines.followups(events.filter("event_type = 'signup'"), events.filter("event_type = 'purchase'"), "user_id")
    return found.select("user_id", "id", "next_id", F.col("rank").cast("long").alias("rank"))


def multiset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", F.explode(F.split("text", "\n")).alias("text"))
    found = lines.moved(docs.filter("n_chars is not null"), F.col("n_chars") < 1000, ["source"])
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("pairs").alias("pairs"))


def closure_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    for t, c, k in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        edges = edges.unionByName(table(spark, sf_dir, t).select(name("n", k).alias("src"), name(t[0], c).alias("dst")))
    edges = edges.unionByName(table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))
    seen, cut = graphs.closure(edges, region.select(name("r", "r_regionkey").alias("root")), 12)
    return seen.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n")).select("root", F.col("depth").cast("long").alias("depth"), "n", F.lit(cut).alias("cut"))


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document's notes come from: a label, else a text in a language and long enough, with the reasons of what has none."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("pkg"), F.col("doc_id").alias("version"), "lang", "n_chars")
    label = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("version")).agg(F.max("quality").alias("quality"))
    labelled = docs.join(label, "version").select("pkg", "version", F.col("quality").cast("string").alias("body"), F.lit(None).cast("string").alias("reason"))
    fits = F.col("lang").isNotNull() & (F.col("n_chars") >= 200)
    own = docs.select("pkg", "version", F.when(fits, F.col("lang")).alias("body"), F.when(F.col("lang").isNull(), "no language").when(~fits, "too short").alias("reason"))
    found = notes.waterfall(docs.filter("pkg is not null").select("pkg", "version"), [("labels", labelled), ("documents", own)])
    return found.select(F.col("version").alias("doc_id"), "body", "found_in", "reason")


def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda cond: F.count_if(cond)
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        n((status == "F") & (price > 400000)).alias("removed"), n((status == "O") & (price > 350000)).alias("changed"), n((status == "P") & (price > 200000)).alias("deprecated"),
        n(priority == "1-URGENT").alias("matched"), n((priority == "2-HIGH") & (status == "F")).alias("unattributed_breaking"), F.count(F.lit(1)).alias("refs"), F.max("o_totalprice").alias("top"),
    )
    zero = {c: F.lit(0).cast("long") for c in ("weak", "unattributed_change", "blind", "opaque", "flagged", "out_of_sync")}
    rows = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("removed", "changed", "deprecated", "matched", "unattributed_breaking", "refs")} | zero)
    rows = rows.withColumns({"failed": F.col("c_acctbal") < 0, "cut": F.col("c_custkey") % 4 == 1, "notes": F.when(F.col("top").isNull(), "unavailable").otherwise("complete"), "bump": F.when(F.col("top") > 420000, "major").otherwise("minor")})
    return verdicts.decide(briefs.surface_state(rows)).select("c_custkey", "verdict", F.concat_ws(",", "reasons").alias("reasons"))


def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what a user's reader sees: errors and purchases as changes of types, the others as notes."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pkg"), F.col("event_id").alias("ord"), "event_type", "value", F.col("event_id").cast("string").alias("id"))
    touched = rows.filter("event_type in ('error', 'purchase')").select("pkg", F.col("id").alias("path"), F.when(F.col("event_type") == "error", "removed").otherwise("changed").alias("bucket"), F.when(F.col("value") > 50, "strong").otherwise("weak").alias("strength"), "ord")
    bucket = F.when(F.col("event_type") == "signup", "unattributed-breaking").when(F.col("event_type") == "click", "matched").otherwise("unattributed-change")
    said = rows.filter("event_type not in ('error', 'purchase')").select("pkg", F.col("id").alias("entry"), bucket.alias("bucket"), (F.col("ord") % 3 == 0).alias("breaking"), (F.col("value") > 50).alias("direct"), (F.col("ord") % 2 == 0).alias("hinted"), "ord")
    found = briefs.findings(touched, said)
    return found.select("pkg", "kind", "id", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


def split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", numbers.held_back(F.concat_ws("#", "source", F.col("doc_id").cast("string"))).alias("held_back"))


def score_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    place = [F.col("source").alias("case"), F.col("lang").alias("file"), F.col("doc_id").alias("line")]
    expected = docs.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select(*place)
    said = F.when(F.col("n_chars") >= 2000, "review").otherwise("quiet")
    reported = docs.select(F.col("source").alias("case"), F.col("lang").alias("file"), F.when(said == "review", F.col("doc_id")).alias("line"), said.alias("verdict"))
    cases = scoring.per_case(expected, reported).withColumn("many", F.col("expected") >= 3)
    return scoring.totals(cases, ["many"])


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.medians(table(spark, sf_dir, "events"), "event_type", "value")
    return found.select("event_type", F.round("median", 6).alias("median"), "upper_median")


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "spec"))
    return held.select("event_id", "name", "spec", paths.spec_kind(F.col("spec")).alias("kind"))


def counted_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts.examples(table(spark, sf_dir, "events"), "event_type", "event_id", "event_id")
    return found.select("event_type", "n", F.concat_ws(",", F.transform("examples", lambda x: x.cast("string"))).alias("examples"))


def uniq_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sites, two to a line: one that is no question before one that is, numbered within the conversation."""
    turns = table(spark, sf_dir, "conversations")
    sites = turns.select("conv_id", F.col("role").alias("file"), F.floor(F.col("turn") / 4).alias("line"), F.coalesce(F.col("text").endswith("?"), F.lit(False)).alias("type_only"), "turn")
    found = briefs.unique_sites(sites, ["conv_id"])
    return found.select("conv_id", F.col("file").alias("role"), "line", "type_only", "turn", F.col("place").cast("long").alias("place"))


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", numbers.content_id(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("content_id"))


def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.coalesce("text", F.lit(""))).alias("sentence"))


def release_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as upgrades: of a nation's repository, of a scope, or alone, by the customer's key."""
    key, status = F.col("o_custkey"), F.col("o_orderstatus")
    name = F.when(key % 3 == 1, F.concat(F.lit("@s"), (key % 7).cast("string"), F.lit("/c"), key.cast("string"))).otherwise(F.concat(F.lit("c"), key.cast("string")))
    rows = table(spark, sf_dir, "orders").select(name.alias("name"), F.year("o_orderdate").cast("string").alias("to"), F.when(key % 3 == 0, F.concat(F.lit("github.com/o/r"), (key % 11).cast("string"))).alias("repository"), F.when(status == "F", "major").when(status == "O", "minor").otherwise("patch").alias("bump"))
    found = history.release_groups(rows)
    return found.select("group", F.size("packages").cast("long").alias("packages"), F.get("packages", F.lit(0)).alias("first"), "bump")


def release_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases found by their repository's tags, where they have any; a month's tags have one spelling."""
    released = _released(spark, sf_dir).withColumn("pkg", F.concat(F.lit("@scope/c"), F.col("pkg").cast("string")))
    month, version, bare = F.month("published_at"), F.col("version"), F.regexp_extract("pkg", "([^/]+)$", 1)
    spelled = (
        F.when(month <= 2, F.concat(F.lit("v"), version)).when(month <= 4, version).when(month == 5, F.concat("pkg", F.lit("@"), version)).when(month == 6, F.concat(bare, F.lit("@"), version))
        .when(month == 7, F.concat("pkg", F.lit("-v"), version)).when(month == 8, F.concat(bare, F.lit("-v"), version)).when(month == 9, F.concat(F.lit("release-"), version)).when(month == 10, F.concat(bare, F.lit("-"), version))
    )
    found = notes.tags(released, released.select("pkg", spelled.alias("tag")).filter("tag is not null"))
    return found.select("pkg", "version", "tag", F.col("scheme").cast("long").alias("scheme"))


def notes_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each package's releases has notes; deprecated ones have none, as every third package that has been asked says itself."""
    released = _released(spark, sf_dir)
    found = notes.waterfall(released.select("pkg", "version"), [("releases", released.filter("not deprecated").select("pkg", "version", F.lit("text").alias("body"), F.lit(None).cast("string").alias("reason")))])
    return notes.coverage(released.select("pkg", "version"), found.withColumn("status", F.when(F.col("body").isNull() & (F.col("pkg") % 3 == 0), "not-published")))


def version_bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each package's newest version before and after a day, where it went up."""
    released = _released(spark, sf_dir)
    early = F.col("published_at") < F.lit("1998-01-01").cast("timestamp")
    newest = lambda rows: rows.groupBy(F.col("pkg").alias("key")).agg(F.max_by("version", semver.key("version")).alias("version")).withColumn("manifest", F.lit("package.json"))
    return history.bumps(newest(released.filter(early)), newest(released.filter(~early))).select("key", "from", "to", "bump")


def changed_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as exports, return flags as units and quantities as fingerprints: what differs between two times."""
    day = F.lit("1998-05-24").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem")
    side = lambda part: part.select(F.lit("lib").alias("pkg"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("int").cast("string").alias("fp"))
    found = usage.changed_exports(side(rows.filter(F.col("l_shipdate") < day)), side(rows.filter(F.col("l_shipdate") >= day)))
    return found.select("path", F.concat_ws(",", "names").alias("names"))


def worst_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst verdict of each nation's customers, and how many of each there are."""
    told = verdict_reasons(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in verdicts.ORDER]
    return told.groupBy("c_nationkey").agg(verdicts.worst("verdict").alias("worst"), *counts)


def prefix_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of addresses as subjects, pages as used paths: which subjects the pages lie at or under."""
    folder = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    used = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("w:"), F.array_join(F.transform(F.filter(F.split(F.translate(folder, ".#", "--"), "/"), lambda p: p != ""), lambda p: p), ".")).alias("path"))
    subjects = used.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("s")).distinct()
    records = subjects.select(F.col("s").alias("entry"), F.array("s").alias("subjects"))
    found = matching.subject_hits(records, used.select("path", F.col("page_id").alias("site")))
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("first"))


def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of events read as settings: the kind, a nested object and a list."""
    rows = table(spark, sf_dir, "events")
    json = F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.array(F.col("event_type"), F.lit("x")).alias("list"), F.col("event_id").alias("number")).alias("deep")))
    found = installed.all_strings(rows.select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), json.alias("content")))
    return found.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))


def highest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranges and a tag pick of each customer's releases."""
    released = _released(spark, sf_dir).select(F.col("pkg").cast("string").alias("name"), "version")
    asked = released.select("name", F.explode(F.array(*map(F.lit, ["^2.0.0", "~3.4", "*", "first", "<1.0.0"]))).alias("range")).distinct()
    tags = released.groupBy("name").agg(F.min_by("version", semver.key("version")).alias("version")).withColumn("tag", F.lit("first"))
    return installed.highest(asked, released, tags)


def name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as references: a part strongly, its supplier weakly; what is strong anywhere isn't weak."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("pkg"), F.col("l_returnflag").alias("file"), F.array((F.col("l_partkey") % 10).cast("string")).alias("strong"), F.array((F.col("l_suppkey") % 10).cast("string")).alias("weak"))
    found = briefs.name_sets(rows)
    return found.select("pkg", F.array_join("strong_names", ",").alias("strong"), F.array_join("weak_names", ",").alias("weak"), "files", "refs")


def sites_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each return flag of an order's lines is used, and an option where no line has it."""
    rows = table(spark, sf_dir, "lineitem")
    refs = rows.select(F.col("l_orderkey").cast("string").alias("pkg"), F.col("l_linestatus").alias("file"), F.col("l_suppkey").alias("line"), (F.col("l_quantity") < 10).alias("type_only"), F.array("l_returnflag").alias("strong"), F.array().cast("array<string>").alias("weak"))
    options = rows.select(F.col("l_orderkey").cast("string").alias("pkg"), F.lit("R").alias("name"), F.lit("call").alias("file"), F.col("l_partkey").alias("line"), F.lit(False).alias("type_only"))
    found = briefs.sites_by_name(refs, options)
    return found.select("pkg", "name", "file", "line", "type_only", F.col("place").cast("long").alias("place"))


def brief_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' briefs in the order in which they are shown."""
    told = verdict_reasons(spark, sf_dir).select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("pkg"), "verdict", F.split("reasons", ",").alias("reasons"))
    found = briefs.groups(told)
    return found.select("pkg", "shown", F.col("place").cast("long").alias("place"), briefs.is_one_net(F.col("reasons")).alias("one_net"))


def coverage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each customer's releases has notes, in words; a status is a source, a deprecated one a reason."""
    released = _released(spark, sf_dir)
    per = released.select("pkg", "version", F.when(~F.col("deprecated"), F.when(F.month("published_at") <= 6, "releases").otherwise("changelog")).alias("source"), F.when(F.col("deprecated"), "stub-body").alias("reason"))
    told = briefs.union_sources(per)
    state = F.when(F.col("found") == F.col("total"), "complete").when(F.col("found") > 0, "partial").otherwise(F.when(F.col("pkg") % 2 == 0, "none-published").otherwise("unavailable"))
    return told.select("pkg", briefs.coverage_label(state, F.col("found"), F.col("total"), F.array_sort("sources"), F.col("reasons")).alias("label"))


def typed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages, the types of one kind beside them; the small ones are referenced."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pkg"), "p_type", "p_size", "p_brand")
    none = F.array().cast("array<string>")
    usage_ = parts.filter("p_size < 25").select("pkg", F.col("p_size").cast("long").alias("refs"), F.lit(1).cast("long").alias("files"), F.array("p_brand").alias("strong_names"), none.alias("weak_names"), none.alias("opaque"), none.alias("blind"))
    own = parts.select("pkg").unionByName(parts.filter("p_type = 'ECONOMY'").select(paths.types_package(F.col("pkg")).alias("pkg")))
    found = briefs.with_types(usage_, own)
    return found.select("pkg", F.col("refs").cast("long").alias("refs"), F.array_join("strong_names", ",").alias("strong"), F.array_join("opaque", ",").alias("opaque"))


def fix_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as removed lines and facts of packages: which orders' fixes are tied, by what."""
    rows = table(spark, sf_dir, "lineitem")
    at = [F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line")]
    name = F.concat(F.lit("part"), (F.col("l_partkey") % 20).cast("string"))
    expected = rows.filter("l_quantity < 20").select(*at, F.concat(name, F.lit("(x)")).alias("text"), F.array(F.lit("p")).alias("packages"))
    added = rows.filter("l_quantity > 45").select(*at[:2], F.concat(F.lit("call."), name).alias("text"))
    kind = F.when(F.col("l_suppkey") % 3 == 0, "site").when(F.col("l_suppkey") % 3 == 1, "option").otherwise("name")
    facts = rows.select(F.col("l_orderkey").alias("id"), F.lit("p").alias("package"), kind.alias("kind"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line"), F.concat(F.lit("part"), (F.col("l_suppkey") % 20).cast("string")).alias("name"))
    found = history.evidence(expected, added, facts)
    return found.select("id", *[F.array_join(c, ",").alias(c) for c in ("on_site", "options", "names")])


def reformatted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as lines of a diff, those of one status removed and the others written: what only moved."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("f").alias("file"), F.col("l_linenumber").alias("line"), F.concat(F.lit("row( '"), F.col("l_returnflag"), F.lit("', "), F.floor(F.col("l_quantity") / 10).cast("string"), F.lit(");")).alias("text"), "l_linestatus")
    found = lines.reformatted(rows.filter("l_linestatus = 'O'"), rows.filter("l_linestatus <> 'O'"))
    return found.select("id", "line")


def registry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages of brands' scopes: the registry of each and the token of its address."""
    parts = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("@"), F.lower(F.translate("p_brand", "#", "")), F.lit("/p"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("pkg"))
    scopes = table(spark, sf_dir, "part").select(F.concat(F.lit("@"), F.lower(F.translate("p_brand", "#", ""))).alias("scope")).distinct()
    rules = scopes.select(F.concat("scope", F.lit(":registry")).alias("key"), F.concat(F.lit("https://r.io/"), F.substring("scope", 2, 99), F.lit("//")).alias("value"))
    rules = rules.unionByName(spark.createDataFrame([("registry", "https://d.io/"), ("//r.io/:_authToken", "wide"), ("//r.io/brand1:_authToken", "narrow")], "key string, value string"))
    chosen = installed.registry_for(parts, installed.registries(rules))
    found = chosen.join(installed.authorized(chosen.select(F.col("registry").alias("url")).distinct(), installed.tokens(rules)).withColumnRenamed("url", "registry"), "registry", "left")
    return found.select("pkg", "registry", "token")


def stale_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each release of a customer as a folder that declares it over a lock of the release before: what it installs, and what is out of step."""
    by = Window.partitionBy("pkg").orderBy(semver.key("version"))
    two = _released(spark, sf_dir).select("pkg", F.col("version").alias("new"), F.coalesce(F.lag("version").over(by), F.col("version")).alias("old"), F.row_number().over(by).alias("rank"))
    dir_ = F.concat(F.lit("c"), F.col("pkg").cast("string"), F.lit("-"), F.col("rank").cast("string"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    own = text('{"dependencies":{"x":"^', F.col("new"), '"}}')
    written_for = F.when(F.col("pkg") % 2 == 0, F.col("new")).otherwise(F.col("old"))
    lock = text('{"packages":{"":{"dependencies":{"x":"^', written_for, '"}},"node_modules/x":{"version":"', F.col("old"), '"}}}')
    files = two.select(F.concat(dir_, F.lit("/package.json")).alias("path"), own.alias("content")).unionByName(two.select(F.concat(dir_, F.lit("/package-lock.json")).alias("path"), lock.alias("content")))
    files = graphs.written(files, "files")
    found = manifests.inventory(manifests.declared(manifests.manifests(files)), files)
    return found.select("dir", "version", "version_source", F.size("out_of_sync").cast("long").alias("late"))


def removed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of two times, where half the parts moved behind an alias and the rest of a package may be unread."""
    day = F.lit("1998-05-24").cast("timestamp_ntz")
    part = F.col("l_partkey").cast("string")
    rows = table(spark, sf_dir, "lineitem")
    none, plain = F.lit(None).cast("string"), F.array(F.lit("() => R"))
    of = lambda path, alias: [F.lit("lib").alias("pkg"), path.alias("path"), F.lit("function").alias("kind"), plain.alias("sig"), F.lit(False).alias("deprecated"), alias.alias("alias_of")]
    before = rows.filter(F.col("l_shipdate") < day).select(*of(F.concat(F.lit("lib:v.p"), part), none)).distinct()
    late = rows.filter((F.col("l_shipdate") >= day) & (F.col("l_returnflag") == "N"))
    after = late.select(*of(F.concat(F.when(F.col("l_partkey") % 2 == 0, F.lit("lib:v.p")).otherwise("lib:default.p"), part), none)).distinct()
    after = after.unionByName(spark.range(1).select(*of(F.lit("lib:v"), F.lit("lib:default"))))
    found = surfaces.diff(before, after).filter("bucket in ('removed', 'unproven')")
    return found.select("path", "bucket")


def _segments(*parts: tuple) -> Column:
    """A chain of (name, call, construct, args), without the parts whose name is null."""
    each = [F.when(name.isNotNull(), F.struct(name.alias("name"), call.alias("call"), construct.alias("construct"), args.cast("int").alias("args"))) for name, call, construct, args in parts]
    return F.array_compact(F.array(*each)).cast(chains.NONE)


def type_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as references walked through regions (namespaces, each with an alias), nations (classes, functions, interfaces) and
    their customers (methods that give a nation): which symbols they reach, and what is left where the type is lost."""
    nation, customer, region = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    none = F.lit(None).cast("string")
    place = nation.select(F.col("n_nationkey").alias("nk"), text("lib:r", F.col("n_regionkey"), ".n", F.col("n_nationkey")).alias("path"), F.col("n_regionkey").alias("rk"))
    spaces = region.select(F.explode(F.array(F.lit("r"), F.lit("a"))).alias("k"), "r_regionkey").select(text("lib:", F.col("k"), F.col("r_regionkey")).alias("path"), F.lit("namespace").alias("kind"), F.when(F.col("k") == "a", text("lib:r", F.col("r_regionkey"))).alias("alias_of"), none.alias("returns"), none.alias("instance_of"))
    next_ = place.select(((F.col("nk") + 24) % 25).alias("nk"), F.col("path").alias("next"))
    kind = F.get(F.array(F.lit("class"), F.lit("function"), F.lit("interface")), (F.col("nk") % 3).cast("int"))
    types = place.join(next_, "nk", "left").select("path", kind.alias("kind"), none.alias("alias_of"), F.when(F.col("nk") % 3 == 1, F.col("next")).alias("returns"), F.when(F.col("nk") % 3 == 0, F.col("path")).alias("instance_of"))
    to = place.select(F.col("nk").alias("to_nk"), F.col("path").alias("to"))
    members = customer.select("c_custkey", F.col("c_nationkey").alias("nk"), (F.col("c_custkey") % 25).alias("to_nk")).join(place, "nk").join(to, "to_nk")
    members = members.select(text(F.col("path"), "#c", F.col("c_custkey")).alias("path"), F.lit("method").alias("kind"), none.alias("alias_of"), F.col("to").alias("returns"), none.alias("instance_of"))
    symbols = graphs.written(spaces.unionByName(types).unionByName(members).withColumn("pkg", F.lit("lib")), "symbols")
    first = customer.groupBy(F.col("c_nationkey").alias("to_nk")).agg(F.min("c_custkey").alias("first"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = orders.join(customer.select("c_custkey", F.col("c_nationkey").alias("nk")), "c_custkey").join(place.select("nk", "rk"), "nk").withColumn("to_nk", F.col("c_custkey") % 25).join(first, "to_nk", "left")
    key = F.col("o_orderkey")
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("int")
    head = text(F.when(key % 2 == 0, F.lit("a")).otherwise(F.lit("r")), F.col("rk"))
    by_name = key % 4 < 2
    chain = _segments(
        (F.when(~by_name, head), no, no, unknown), (text("n", F.col("nk")), key % 3 > 0, key % 3 == 2, unknown), (text("c", F.col("c_custkey")), key % 5 > 0, no, key % 5),
        (text("c", F.col("first")), key % 7 == 0, no, unknown), (F.when(key % 7 < 2, F.lit("x")), no, no, unknown),
    )
    refs = rows.select("o_orderkey", F.lit("lib").alias("pkg"), F.lit("lib").alias("prefix"), F.when(by_name, "named").otherwise("namespace").alias("binding"), F.when(by_name, head).alias("imported"), no.alias("called"), chain.alias("chain"))
    found = chains.walk(refs, symbols, spark.range(1).select(F.lit("lib").alias("pkg"), F.lit("lib").alias("prefix")))
    told = F.transform("paths", lambda p: F.concat_ws("/", p["path"], p["args"].cast("string")))
    return found.select("o_orderkey", F.array_join(told, " ").alias("paths"), F.array_join("unresolved", " ").alias("unresolved"), "missing_head")


def _program(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as files and their orders as lines that assign: of a package, of a value before or behind, of the next customer's file."""
    key = F.col("o_orderkey")
    v = lambda k: F.concat(F.lit("v"), k.cast("string"))
    file = lambda k: F.concat(F.lit("f"), k.cast("string"))
    of = F.floor(key / 4) % 7
    local = F.when(of == 5, "lib").when(of == 6, "other").otherwise(v(of))
    chain = _segments((F.when(key % 3 > 0, F.concat(F.lit("m"), (key % 3).cast("string"))), key % 2 == 0, F.lit(False), F.lit(None)))
    lines_ = table(spark, sf_dir, "orders").select(file(F.col("o_custkey")).alias("file"), key.alias("pos"), v(key % 5).alias("into"), local.alias("local"), chain.alias("chain"), (key % 4 == 1).alias("called"), (F.col("o_orderpriority") == "5-LOW").alias("handed"))
    files = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    pkg = F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string"))
    none = F.lit(None).cast("string")
    own = file(F.col("o_custkey")).alias("file")
    imports = files.select(own, F.lit("lib").alias("local"), pkg.alias("pkg"), pkg.alias("prefix"), F.lit("namespace").alias("binding"), none.alias("imported"), none.alias("target"))
    imports = imports.unionByName(files.select(own, F.lit("other").alias("local"), none.alias("pkg"), none.alias("prefix"), F.lit("named").alias("binding"), F.lit("v1").alias("imported"), file(F.col("o_custkey") + 1).alias("target")))
    return {
        "imports": graphs.written(imports, "imports"),
        "assignments": lines_.filter("not handed").drop("handed"),
        "callbacks": lines_.filter("handed").select("file", "pos", "into", "local"),
        "exports": files.filter("o_custkey % 2 = 0").select(own, F.lit("v1").alias("exported"), F.lit("v1").alias("local")),
        "re_exports": files.filter("o_custkey % 2 = 1").select(own, F.lit("v1").alias("name"), F.lit("v1").alias("imported"), file(F.col("o_custkey") + 1).alias("target")),
    }


def _chain_text(chain: str) -> Column:
    return F.array_join(F.transform(chain, lambda s: F.concat(s["name"], F.when(s["call"], "()").otherwise(""))), ".")


def derived_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names of customers' files hold a package's value, through how many files, and what made them."""
    found = values.derived(**_program(spark, sf_dir))
    return found.select("file", "name", "pkg", F.col("hops").cast("long").alias("hops"), "cut", _chain_text("built").alias("built"), "built_called")


def touched_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From references to changes: lines of customers' files attributed by all ways, walked through surfaces made of the parts, and what changed there."""
    program = _program(spark, sf_dir)
    facts = values.derived(**program)
    v = F.col("l_partkey") % 8
    local = F.when(v < 5, F.concat(F.lit("v"), v.cast("string"))).when(v == 5, "lib").when(v == 6, "other").otherwise("none")
    m = lambda k: F.concat(F.lit("m"), k.cast("string"))
    no, unknown = F.lit(False), F.lit(None)
    chain = _segments((m(F.col("l_suppkey") % 3), F.col("l_quantity") < 25, no, unknown), (F.when(F.col("l_suppkey") % 2 == 0, m(F.floor(F.col("l_suppkey") / 3) % 3)), no, no, unknown))
    file = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file"))
    refs = table(spark, sf_dir, "lineitem").join(file, "l_orderkey").select("file", F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("col"), local.alias("local"), chain.alias("chain"), no.alias("called"))
    origin = program["re_exports"].select("file", "name", F.lit(None).cast("string").alias("pkg"), "imported").filter("false")
    ways = values.attributed(refs, program["imports"], origin, values.handed_on(program["exports"], program["re_exports"]), facts)
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    owner, pkg = F.floor(key / 3) % 4, F.concat(F.lit("p"), (key % 3).cast("string"))
    top = F.concat(pkg, F.lit(":"))
    member = F.when(owner == 3, F.concat(top, m(F.floor(key / 12) % 3))).otherwise(F.concat(top, F.lit("T"), owner.cast("string"), F.lit("#"), m(F.floor(key / 12) % 3)))
    rows = part.groupBy(pkg.alias("pkg"), member.alias("path"), (owner == 3).alias("top")).agg(F.min("p_size").alias("size"), F.min("p_partkey").alias("first"))
    none = F.lit(None).cast("string")
    gives = F.concat("pkg", F.lit(":T"), (F.col("size") % 4).cast("string"))
    symbols = rows.select("pkg", "path", F.when(F.col("top"), "function").otherwise("method").alias("kind"), none.alias("alias_of"), gives.alias("returns"), none.alias("instance_of"))
    bucket = F.when(F.col("first") % 5 == 0, "removed").when(F.col("first") % 2 == 0, "changed")
    changes = rows.select("pkg", "path", bucket.alias("bucket")).filter("bucket is not null")
    walked = chains.walk(ways.filter("blind is null"), symbols, rows.select("pkg", F.col("pkg").alias("prefix")).distinct())
    reach = graphs.written(chains.reached(walked.select("pkg", "file", "line", "col", "way", "paths", "unresolved", "missing_head")), "reached")
    return surfaces.touched(reach, changes, ["file", "line", "col", "way"]).select("file", "line", "col", "pkg", "path", "bucket", "strength", "way").distinct()


def _project(spark: SparkSession, sf_dir: str) -> assembly.Project:
    """Customers as packages, their orders as releases with surfaces (the parts of their lines) and notes, their first order's lines as references."""
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    released = _released(spark, sf_dir).withColumn("custkey", F.col("pkg")).withColumn("pkg", name("pkg"))
    released = graphs.written(released, "releases")
    own = released.groupBy("pkg", "custkey").agg(F.min_by("version", semver.key("version")).alias("version"))
    of = lambda cond, x: F.when(cond, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    installed_ = own.select("pkg", "version", F.lit("lockfile").alias("version_source"), F.array(F.lit("package.json")).alias("manifests"), of(F.col("custkey") % 11 == 0, "patched").alias("flags"), F.when(F.col("custkey") % 13 == 0, 1).otherwise(0).alias("out_of_sync"))
    d = F.col("o_orderdate")
    version = F.concat_ws(".", (F.year(d) - 1995).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), name("o_custkey").alias("pkg"), version.alias("version"))
    each = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    each = graphs.written(each.withColumn("part", F.concat(F.lit("part"), (F.col("l_partkey") % 6).cast("string"))).select("custkey", "pkg", "version", "part", "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity"), "lines")
    none = F.lit(None).cast("string")
    sig = F.array(F.concat(F.lit("() => R"), (F.min(F.col("l_quantity").cast("int")) % 4).cast("string")))
    symbols = each.groupBy("pkg", "version", F.concat("pkg", F.lit(":"), "part").alias("path")).agg(sig.alias("sig"), F.bool_or(F.col("l_returnflag") == "R").alias("deprecated"))
    symbols = symbols.select("pkg", "version", "path", F.lit("function").alias("kind"), "sig", "deprecated", none.alias("alias_of"), none.alias("returns"), none.alias("instance_of"))
    used = each.join(own.select("pkg", F.col("version").alias("first")), "pkg").filter((F.col("version") == F.col("first")) | ((F.col("custkey") % 3 == 0) & (F.col("l_quantity") > 25)))
    references = used.select(
        "pkg", F.concat(F.lit("src/f"), F.col("l_linenumber").cast("string"), F.lit(".ts")).alias("file"), F.col("l_orderkey").alias("line"), F.lit(1).alias("col"), (F.col("l_linestatus") == "F").alias("type_only"), F.lit("use").alias("code"), none.alias("via"),
        F.lit("direct").alias("way"), F.lit(0).alias("hops"), F.col("pkg").alias("prefix"), F.lit("named").alias("binding"), F.col("part").alias("imported"), F.lit(False).alias("called"), F.array().cast(chains.NONE).alias("chain"),
        F.lit(None).cast(chains.NONE).alias("built"), F.lit(None).cast("boolean").alias("built_called"), F.when(F.col("l_quantity") > 49, "namespace-escape").alias("blind"),
    )
    opaque = table(spark, sf_dir, "customer").filter("c_acctbal < -500").select(name("c_custkey").alias("pkg"), F.lit("side-effect-import").alias("kind"))
    key = F.col("o_orderkey")
    said = F.get(F.array(F.concat(F.lit("- Fixed a wrong result of `part"), (key % 7).cast("string"), F.lit("`")), F.lit("- Fixed a wrong result somewhere in the code"), F.lit("- BREAKING CHANGE: old runtimes no longer work"), F.lit("- chore: bump tools")), (key % 5).cast("int"))
    bodies = orders.groupBy("pkg", "version").agg(F.min("o_orderkey").alias("o_orderkey")).select("pkg", "version", said.alias("body"), F.when(said.isNull(), "stub-body").alias("reason"))
    latest = released.groupBy("pkg").agg(F.max_by("version", "published_at").alias("latest"))
    return assembly.Project(installed_, released.drop("custkey"), latest, symbols, symbols.select("pkg", "version", F.col("pkg").alias("prefix"), F.array().cast("array<string>").alias("external")).distinct(), graphs.written(references, "references"), opaque, [("releases", bodies)])


def upgrade_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's upgrade from candidate to verdict, read off its document."""
    found = assembly.documents(assembly.stages(_project(spark, sf_dir), F.lit("2001-09-01").cast("timestamp"), 180))
    d = F.col("document")
    reasons = F.array_join(F.transform(d["reasons"], lambda r: r["code"]), ",")
    n = lambda c: F.size(c).cast("long")
    return found.select(
        "pkg", d["from"].alias("from"), d["to"].alias("to"), d["bump"].alias("bump"), d["verdict"].alias("verdict"), reasons.alias("reasons"), d["types"]["changes"].alias("changes"), n(d["types"]["touched"]).alias("touched"),
        d["notes"]["coverage"].alias("coverage"), d["notes"]["entries"].alias("entries"), n(d["notes"]["matched"]).alias("matched"), n(d["notes"]["changesWithoutApi"]).alias("unplaced"), d["usage"]["sites"].alias("sites"), F.array_join(d["usage"]["names"]["exact"], ",").alias("names"), n(F.map_keys(d["usage"]["sitesByName"])).alias("named_sites"),
    )


def branch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pull requests: users' turns as a bot's commits, texts of a length as merges; where the fix on top begins and ends."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), (F.col("role") == "user").alias("bot"), F.when(F.length("text") % 7 == 0, 2).otherwise(1).alias("parents"))
    return history.branch(turns).select("id", "reason", "upgraded", "fix_from", "fix_to", "fixes")


def tag_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases that a first page of tags (those of two months) hasn't, asked for one by one, until five tags of a package have been."""
    released = _released(spark, sf_dir).withColumn("pkg", F.concat(F.lit("c"), F.col("pkg").cast("string")))
    month, by_v = F.month("published_at"), F.concat(F.lit("v"), F.col("version"))
    page = released.filter(month <= 2).select("pkg", by_v.alias("tag"))
    tag = F.when((month % 3 == 0) | (month == 10), by_v).when(month == 5, F.concat_ws("@", "pkg", "version"))
    answers = released.select("pkg", tag.alias("tag"), F.when(month == 10, "rate-limited").otherwise("found").alias("outcome")).filter("tag is not null")
    found = notes.lookups(released.select("pkg", "version"), page, answers, 5)
    return found.select("pkg", "version", F.array_join("asked", ",").alias("asked"), "tag", "failure", "skipped")


def path_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as folders whose settings inherit a region's or have their own; what each customer's import of itself leads to."""
    nation = table(spark, sf_dir, "nation")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    inherits = text('{"extends": "../r', F.col("n_regionkey"), '/tsconfig"} // inherited')
    own = nation.select(text("n", F.col("n_nationkey"), "/tsconfig.json").alias("path"), F.when(F.col("n_nationkey") % 2 == 0, inherits).otherwise(F.lit('{"compilerOptions": {"paths": {"@/*": ["own/*"],},},}')).alias("content"))
    shared = table(spark, sf_dir, "region").select(text("r", F.col("r_regionkey"), "/tsconfig.json").alias("path"), F.lit('{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["lib/*", "gen/*"]}}}').alias("content"))
    documents = graphs.written(own.unionByName(shared), "documents")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_regionkey")
    k = F.col("c_custkey")
    folder = text("n", F.col("n_nationkey"), "/")
    places = F.array(text(folder, "c", k, ".ts"), F.when(k % 3 == 0, text("r", F.col("n_regionkey"), "/lib/c", k, ".js")), F.when(k % 3 <= 1, text("r", F.col("n_regionkey"), "/gen/c", k, "/index.ts")), F.when(k % 5 == 0, text(folder, "own/c", k, ".tsx")))
    files = graphs.written(rows.select(F.explode(F.array_compact(places)).alias("path")), "files")
    nearest = settings.nearest_settings(files, documents, settings.path_settings(documents))
    return settings.aliased(rows.select(text(folder, "c", k, ".ts").alias("file"), text("@/c", k).alias("specifier")), nearest, files, table(spark, sf_dir, "part").select(F.col("p_name").alias("pkg")).filter("false"))


def settings_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as style sheets and customers as settings files: which parts' packages they name, and where."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    names = table(spark, sf_dir, "part").select(text("p", F.col("p_partkey")).alias("name"), text("p", F.col("p_partkey")).alias("pkg"))
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    sheets = table(spark, sf_dir, "supplier").select(text("s", s, ".css").alias("path"), text('@import "p', s % 97, '/a.css";\n\n@use\n "~p', s % 89, '"; @import "./b.css";\n@config "q";').alias("content"))
    rcs = table(spark, sf_dir, "customer").select(text("c", c, "/.toolrc").alias("path"), text('{"x": 1,\n "plugins": ["p', c % 83, '/plugin", {"deep":\n "p', c % 79, '"}]}').alias("content"))
    documents = graphs.written(sheets.unionByName(rcs), "documents")
    found = settings.style_imports(documents, names).unionByName(settings.config_references(installed.all_strings(documents.filter("path like '%rc'")), documents, names))
    return found.select("pkg", "kind", "path", "line")


def tied_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members of nations, which are namespaces or deprecated classes, some under another name: what is said of those that went."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    n, none = F.col("n_nationkey"), F.lit(None).cast("string")
    nations = table(spark, sf_dir, "nation").select(text("lib:n", n).alias("path"), F.when(n % 2 == 0, "namespace").otherwise("class").alias("kind"), (n % 3 == 0).alias("deprecated"), F.when(n % 5 == 1, text("lib:n", (n + 2) % 25)).alias("alias_of"))
    members = table(spark, sf_dir, "customer").select(text("lib:n", F.col("c_nationkey"), ".c", F.col("c_custkey")).alias("path"), F.lit("function").alias("kind"), F.lit(False).alias("deprecated"), none.alias("alias_of"))
    before = graphs.written(nations.unionByName(members).withColumn("pkg", F.lit("lib")), "symbols")
    entry = spark.range(1).select(F.lit("lib").alias("pkg"), F.lit("lib").alias("prefix"), F.lit(False).alias("export_equals"))
    found = matching.removal_facts(before.select("pkg", "path", F.array().cast("array<string>").alias("also_at")), before, entry, entry)
    return found.select("path", "namespace", "was_deprecated")


def adapting_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as repositories and events as commits: those that follow a sign-up within a fortnight, name what it upgraded and touch it."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type")
    upgrades = events.filter("event_type = 'signup'").select("repo", "id", "at", F.lit("@shop/purchase").alias("pkg"))
    subject = F.when(F.col("id") % 5 == 0, "Revert it").otherwise(F.concat_ws(" ", F.lit("on"), "event_type"))
    touched = events.filter("id % 3 > 0").select("id", F.lit("@shop/purchase").alias("pkg"))
    found = lines.adapting_followups(upgrades, events.select("repo", "id", "at", subject.alias("subject")), touched)
    return found.select("id", "next_id", F.col("rank").cast("long").alias("rank"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        name_text_match, df_demotion, match_buckets, entry_kind, entry_regions, html_clean, url_parts, fence_parity, line_runs, split_entries, candidate_pick,
        semver_sort, bump_kinds, range_matches, snapshot_plan, surface_diff, drop_children, collapse_changes, longest_prefix, followup_interval, multiset_lines,
        closure_reach, waterfall, verdict_reasons, findings_order, split_80_20, score_totals, medians, manifest_rows, counted_examples, uniq_sites, content_ids,
        first_sentences, release_groups, release_tags, notes_coverage, version_bumps, changed_exports, worst_verdicts, title_scopes, prefix_reach, json_strings,
        highest_versions, name_sets, sites_by_name, brief_groups, coverage_labels, typed_usage, fix_evidence, reformatted_lines, registry_choice, stale_locks, removed_names,
        type_walk, derived_values, touched_uses, upgrade_briefs, branch_split, tag_lookups, path_aliases, settings_uses, tied_removals, adapting_commits,
    )
}
