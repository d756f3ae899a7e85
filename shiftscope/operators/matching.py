"""Names in use matched to the text of release notes, and what is left unattributed.

Tables:

* regions: entry string, ord int, kind string (title, prose, inline-code, code-block), text string;
* names: name string, strength string (strong, weak);
* entries: entry string, kind string, breaking boolean, names_api string (headline, text, none); `rules` makes them and
  `regions` of what `entries.split` gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as T
from . import graphs

#: A name in the examples of so many entries, and of such a share of those with examples, is boilerplate.
DEMOTE_LEAST, DEMOTE_SHARE = 3, 0.25


def tokens(text: Column) -> Column:
    """Identifier-shaped tokens."""
    return F.regexp_extract_all(text, F.lit(r"[\w$]+"), F.lit(0))


def _pattern(name: Column) -> Column:
    """How a name is written as itself: after a dot if it is short, anywhere if it looks like code, else as code."""
    n = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    short = F.concat(F.lit(r"(?<=\.)"), n, F.lit(r"(?![\w$])"))
    shaped = F.concat(F.lit(r"(?<![\w$])"), n, F.lit(r"(?![\w$])"))
    plain = F.concat(short, F.lit(r"|(?<![\w$.])"), n, F.lit(r"(?=\s*[(<])|(?<=<)"), n, F.lit(r"(?![\w$])"))
    return F.when(F.length(name) <= 2, short).when(T.is_code_shaped(name), shaped).otherwise(plain)


def region_rows(entries: DataFrame, pointed: DataFrame | None = None) -> DataFrame:
    """entry, ord, kind, text of the live entries' regions, and behind them those of the sections that they point to.

    entries: id, version, regions, noise; pointed: id, section (notes.pointed).
    """
    live = entries.filter("not noise")
    own = live.select(F.col("id").alias("entry"), F.posexplode("regions").alias("ord", "r"))
    if pointed is not None:
        told = pointed.join(live.select(F.col("id").alias("section"), "regions"), "section").select(F.col("id").alias("entry"), F.posexplode("regions").alias("ord", "r"))
        own = own.unionByName(told.join(live.select(F.col("id").alias("entry")), "entry", "left_semi").withColumn("ord", F.col("ord") + 1_000_000))
    return own.select("entry", "ord", "r.kind", "r.text")


def rules(entries: DataFrame) -> DataFrame:
    """entry, version, kind, breaking, names_api, scope, title of the live entries: what the rules read of each by itself.

    scope: the API that a title starts with, if the rest of the title doesn't name another.
    """
    scope = T.commit_scope(F.col("title"))
    own = F.when(~T.names_another_api(F.col("title"), F.col("regions"), scope), scope)
    return entries.filter("not noise").select(F.col("id").alias("entry"), "version", "kind", "breaking", T.names_api(F.col("regions")).alias("names_api"), own.alias("scope"), "title")


def mentions(regions: DataFrame, names: DataFrame) -> DataFrame:
    """entry, name, kind, first (the region's place): which names each entry writes, and where.

    Tokens meet names in an equi join, so texts times names never meet, and texts don't travel with tokens. A name
    that looks like code and is one token is written where that token is; pairs of other names go back to their
    text (entry, ord) and are held to the name's own pattern. A name of several tokens is looked for by its longest. A code
    span that is a package named after a member (`parser-it` for `parser`) also writes that name.
    """
    wanted = names.select("name").distinct().withColumn("token", F.element_at(F.array_sort(tokens(F.col("name")), lambda a, b: F.length(b) - F.length(a)), 1))
    each = regions.select("entry", "ord", "kind", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    # written, so that texts are cut into tokens once
    met = each.join(wanted.filter("token is not null"), "token").select("entry", "ord", "kind", "name", ((F.col("name") == F.col("token")) & T.is_code_shaped(F.col("name")) & (F.length("name") > 2)).alias("sure"))
    met = graphs.written(met, "mentions")
    doubtful = met.filter("not sure").join(regions.select("entry", "ord", "text"), ["entry", "ord"]).filter(F.rlike("text", _pattern(F.col("name"))))
    member = F.regexp_extract("text", r"^\s*([^@\s]+)-[a-z][a-z0-9]*(?:@[\w.^~-]+)?\s*\z", 1)
    behind = regions.filter("kind = 'inline-code'").select("entry", "ord", "kind", member.alias("name")).filter(F.length("name") >= 3).join(names.select("name").distinct(), "name", "left_semi")
    own = ["entry", "ord", "kind", "name"]
    found = met.filter("sure").select(*own).unionByName(doubtful.select(*own)).unionByName(behind.select(*own))
    return found.groupBy("entry", "name", "kind").agg(F.min("ord").alias("first"))


def scoped(ruled: DataFrame, names: DataFrame) -> DataFrame:
    """Rows as of mentions() for the names, of three letters and more, that are an entry's scope; they count as in its title."""
    met = ruled.filter("scope is not null").join(names.select(F.col("name").alias("scope")).distinct(), "scope").filter(F.length("scope") >= 3)
    return met.select("entry", F.col("scope").alias("name"), F.lit("title").alias("kind"), F.lit(-1).alias("first"))


def option_hits(regions: DataFrame, options: DataFrame) -> DataFrame:
    """entry, name, region: of each option (name) that an entry names, the first region that does."""
    each = regions.select("entry", "ord", "kind", F.explode(T.option_candidates(F.struct("kind", "text"))).alias("name"))
    return each.join(options.select("name").distinct(), "name").groupBy("entry", "name").agg(F.min_by("kind", "ord").alias("region"))


def demoted(found: DataFrame, regions: DataFrame, least: int = DEMOTE_LEAST, part: float = DEMOTE_SHARE, by: list[str] | None = None) -> DataFrame:
    """by, name, n, total: names whose mentions in examples say nothing, as n of the total entries with examples have them.

    by: columns of both tables within which entries are counted; none for all.
    """
    by = by or []
    total = regions.filter("kind = 'code-block'").groupBy(*by, F.lit(1).alias("one")).agg(F.count_distinct("entry").alias("total"))
    often = found.filter("kind = 'code-block'").groupBy(*by, F.lit(1).alias("one"), "name").agg(F.count_distinct("entry").alias("n"))
    met = often.join(total, [*by, "one"])
    return met.filter((F.col("n") >= least) & (F.col("n") >= part * F.col("total"))).select(*by, "name", "n", "total")


def hits(found: DataFrame, names: DataFrame, entries: DataFrame, boilerplate: DataFrame, by: list[str] | None = None) -> DataFrame:
    """entry, name, strength, region: of each mention the first region that counts.

    An example doesn't count for a demoted name, unless the entry is breaking, nor for a weak name that looks like a plain word.
    by: columns of entries, names and boilerplate, such as a package, within which names count.
    """
    by = by or []
    best = names.groupBy(*by, "name").agg(F.min("strength").alias("strength"))  # strong before weak
    met = found.join(entries.select(*by, "entry", "breaking"), "entry").join(best, [*by, "name"]).join(boilerplate.select(*by, "name").distinct().withColumn("demoted", F.lit(True)), [*by, "name"], "left")
    silent = (F.col("kind") == "code-block") & ((F.coalesce("demoted", F.lit(False)) & ~F.col("breaking")) | ((F.col("strength") == "weak") & ~T.is_code_shaped(F.col("name"))))
    return met.filter(~silent).groupBy("entry", "name", "strength").agg(F.min_by("kind", "first").alias("region"))


def buckets(entries: DataFrame, found: DataFrame, types_read: bool = True) -> DataFrame:
    """entries with n_hits, direct and bucket: matched, unattributed-breaking, unattributed-change or none.

    No entry is dropped on the way: what no name matches is a bucket of its own. Housekeeping has none.
    """
    per = found.groupBy("entry").agg(F.count(F.lit(1)).alias("n_hits"), F.bool_or((F.col("strength") == "strong") & (F.col("region") != "code-block")).alias("direct"))
    met = entries.join(per, "entry", "left").withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "direct": F.coalesce("direct", F.lit(False))})
    unread = F.lit(not types_read)
    return met.withColumn(
        "bucket",
        F.when(F.col("kind") == "housekeeping", "none")
        .when(F.col("n_hits") > 0, "matched")
        .when(F.col("breaking") & (F.col("names_api") != "headline"), "unattributed-breaking")
        .when((F.col("kind") == "change") & ((F.col("names_api") == "none") | unread), "unattributed-change")
        .otherwise("none"),
    )


def matched_order(matched: DataFrame) -> list[Column]:
    """Breaking first, then direct, then as they came."""
    return [F.desc("breaking"), F.desc("direct"), F.asc("ord")]


def subject_path(subject: Column) -> Column:
    """The symbol path of a subject, `lib:Parser` of "lib:Parser{strict}"."""
    return F.regexp_replace(subject, r"\{[^{}]+\}\z", "")


def subject_option(subject: Column) -> Column:
    """The option of a subject; null without one."""
    found = F.regexp_extract(subject, r"^.*\{([^{}]+)\}\z", 1)
    return F.when(found != "", found)


def subject(path: Column, option: Column) -> Column:
    return F.when(option.isNull(), path).otherwise(F.concat(path, F.lit("{"), option, F.lit("}")))


def provable(records: DataFrame, entries: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """records (entry, version, subjects, ...) of entries there are, with the subjects that either surface has, sorted, each once.

    symbols: path, options array, alias_of of both surfaces; without it subjects are kept as they are. An option is
    looked for where up to five aliases of its path lead.
    """
    known = records.join(entries.select(F.col("id").alias("entry"), "version").distinct(), ["entry", "version"], "left_semi")
    known = known.withColumn("subjects", F.array_sort(F.array_distinct(F.coalesce("subjects", F.array().cast("array<string>")))))
    if symbols is None:
        return known
    rows = known.withColumn("row", F.monotonically_increasing_id())
    rows = graphs.written(rows, "records")
    each = rows.select("row", F.explode("subjects").alias("subject")).withColumns({"path": subject_path(F.col("subject")), "option": subject_option(F.col("subject"))})
    table = graphs.written(symbols.select("side", "path", F.coalesce("options", F.array().cast("array<string>")).alias("options"), "alias_of"), "symbols")
    open_ = each.join(table, "path")
    fits = lambda: F.col("option").isNull() | F.array_contains("options", F.col("option"))
    done = open_.filter(fits()).select("row", "subject")
    for _ in range(5):
        open_ = open_.filter(~fits() & (F.size("options") == 0) & F.col("alias_of").isNotNull()).select("row", "subject", "option", "side", F.col("alias_of").alias("path")).join(table, ["side", "path"])
        done = done.unionByName(open_.filter(fits()).select("row", "subject"))
    kept = done.distinct().groupBy("row").agg(F.array_sort(F.collect_set("subject")).alias("kept"))
    return rows.join(kept, "row", "left").withColumn("subjects", F.coalesce("kept", F.array().cast("array<string>"))).select(*known.columns)


def subject_hits(records: DataFrame, reached: DataFrame) -> DataFrame:
    """entry, name, subject, site: the subjects of records that the code reaches, by a used path at the subject or under it.

    reached: path, site. Used paths meet subjects by their ancestors, so nothing is compared by prefix.
    """
    each = records.select("entry", F.explode("subjects").alias("subject")).distinct()
    each = each.withColumns({"path": subject_path(F.col("subject")), "name": F.coalesce(subject_option(F.col("subject")), paths.last_name(subject_path(F.col("subject"))))})
    above = reached.select("site", F.explode(F.array_append(paths.ancestors(F.col("path")), F.col("path"))).alias("path"))
    return each.join(above.distinct(), "path").select("entry", "name", "subject", "site")


def removals_tied(breaking: DataFrame, removed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """entry, name, subject: breaking notes that name no API tied to the used removals that they describe.

    breaking: entry, regions; removed: path, namespace boolean (went with a namespace), was_deprecated boolean, one row for
    each used removal (`removal_facts`). by: columns of both, such as a package. A note that says "namespace" is about those alone, one that says "deprecated" about the deprecated.
    """
    words = F.array_join(F.transform(F.filter("regions", lambda r: r["kind"] != "code-block"), lambda r: r["text"]), "\n")
    about = F.when(words.rlike(r"(?i)(?<![\w$])namespaces?(?![\w$])"), "namespace").when(words.rlike(r"(?i)(?<![\w$])deprecated(?![\w$])"), "deprecated")
    by = by or []
    said = breaking.select(*by, "entry", about.alias("about")).filter("about is not null")
    kinds = removed.select(*by, "path", F.explode(F.array(F.when(F.col("namespace"), F.lit("namespace")), F.when(F.col("was_deprecated"), F.lit("deprecated")))).alias("about")).filter("about is not null")
    met = said.join(kinds, [*by, "about"]).withColumn("name", paths.last_name(F.col("path")))
    return met.groupBy("entry", "name").agg(F.min("path").alias("subject"))


def removal_facts(removed: DataFrame, before: DataFrame, entries_before: DataFrame, entries_after: DataFrame) -> DataFrame:
    """pkg, path, namespace, was_deprecated: what both surfaces say of used removals (pkg, path, also_at).

    namespace: one of its paths was a namespace, or its entry handed on a namespace whole (export_equals, without a symbol of its own) and no longer
    does. was_deprecated: one of its paths, or a path above one, was marked, itself or through at most five aliases.
    before: pkg, path, kind, deprecated, alias_of; entries: pkg, prefix, export_equals.
    """
    each = removed.select("pkg", "path", F.explode(F.array_append("also_at", F.col("path"))).alias("at")).distinct()
    was = before.filter("kind = 'namespace'").select("pkg", F.col("path").alias("at")).distinct().withColumn("space", F.lit(True))
    roots = before.select("pkg", F.regexp_extract("path", r"^([^:]*):\z", 1).alias("prefix")).filter("prefix <> ''").distinct().withColumn("rooted", F.lit(True))
    whole = entries_before.filter("export_equals").select("pkg", "prefix").distinct()
    gone = whole.join(entries_after.filter("export_equals").select("pkg", "prefix"), ["pkg", "prefix"], "left_anti").join(roots, ["pkg", "prefix"], "left_anti").withColumn("left", F.lit(True))
    marked = before.select("pkg", F.col("path").alias("up"), F.coalesce("deprecated", F.lit(False)).alias("old"), F.col("alias_of").alias("to"))
    for _ in range(5):
        known = before.select("pkg", F.col("path").alias("to"), F.coalesce("deprecated", F.lit(False)).alias("to_old"), F.col("alias_of").alias("beyond"))
        met = marked.join(known, ["pkg", "to"], "left")
        marked = met.select("pkg", "up", (F.col("old") | F.coalesce("to_old", F.lit(False))).alias("old"), F.when(~F.col("old"), F.col("beyond")).alias("to"))
    above = each.select("pkg", "path", F.explode(F.array_append(paths.ancestors(F.col("at")), F.col("at"))).alias("up")).distinct()
    old = above.join(marked.filter("old").select("pkg", "up"), ["pkg", "up"], "left_semi").select("pkg", "path").distinct().withColumn("was_deprecated", F.lit(True))
    spaces = each.withColumn("prefix", F.regexp_extract("at", r"^([^:]*):", 1)).join(was, ["pkg", "at"], "left").join(gone, ["pkg", "prefix"], "left")
    told = spaces.groupBy("pkg", "path").agg(F.bool_or(F.coalesce("space", F.lit(False)) | F.coalesce("left", F.lit(False))).alias("namespace"))
    return told.join(old, ["pkg", "path"], "left").withColumn("was_deprecated", F.coalesce("was_deprecated", F.lit(False)))


def with_tied(bucketed: DataFrame, ties: DataFrame) -> DataFrame:
    """bucketed (entry, bucket, direct, ...) with the breaking notes that ties (entry, name, subject) explain moved to matched, never direct, and the tied names."""
    names = ties.groupBy("entry").agg(F.array_sort(F.collect_set("name")).alias("tied"))
    moved = F.col("tied").isNotNull() & (F.col("bucket") == "unattributed-breaking")
    met = bucketed.join(names, "entry", "left")
    return met.withColumns({"bucket": F.when(moved, "matched").otherwise(F.col("bucket")), "direct": F.when(moved, False).otherwise(F.col("direct")), "tied": F.when(moved, F.col("tied")).otherwise(F.array().cast("array<string>"))})
