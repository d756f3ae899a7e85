"""Release notes: where each version's text comes from, its sections and entries, and how complete the reading is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semver
from ..functions import text as T
from . import graphs, lines


def waterfall(wanted: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """wanted (pkg, version) with body, found_in, reason: the first source in order that has a text.

    sources: name and table (pkg, version, body, reason); a missing body with a reason tells why that source had none.
    No version is dropped: what no source has keeps all reasons.
    """
    out = wanted.withColumns({"body": F.lit(None).cast("string"), "found_in": F.lit(None).cast("string"), "reasons": F.array().cast("array<string>")})
    for name, table in sources:
        own = table.groupBy("pkg", "version").agg(F.max("body").alias("__body"), F.max("reason").alias("__reason"))
        met = out.join(own, ["pkg", "version"], "left")
        open_, has = F.col("body").isNull(), F.trim(F.coalesce("__body", F.lit(""))) != ""
        why = F.when(open_ & ~has, F.array(F.concat(F.lit(f"{name}: "), F.coalesce("__reason", F.lit("not found"))))).otherwise(F.array().cast("array<string>"))
        out = met.select(*wanted.columns, F.when(open_ & has, F.col("__body")).otherwise(F.col("body")).alias("body"), F.when(open_ & has, F.lit(name)).otherwise(F.col("found_in")).alias("found_in"), F.concat("reasons", why).alias("reasons"))
    return out.select(*wanted.columns, "body", "found_in", F.when(F.col("found_in").isNull(), F.concat_ws("; ", "reasons")).alias("reason"))


def coverage(ranges: DataFrame, read: DataFrame) -> DataFrame:
    """pkg, coverage: complete, partial, unavailable or none-published; a package without versions in range is complete.

    ranges: pkg, version (null for an empty range); read: pkg, version, body and, if given, status: `not-published`
    where a source could be asked and has nothing. Without a status what has no body is unavailable.
    """
    status = F.col("status") if "status" in read.columns else F.lit(None).cast("string")
    told = read.groupBy("pkg", "version").agg(F.bool_or(F.col("body").isNotNull()).alias("has"), F.bool_or(F.coalesce(status == "not-published", F.lit(False))).alias("none"))
    met = ranges.join(told, ["pkg", "version"], "left")
    per = met.groupBy("pkg").agg(F.count("version").alias("n"), F.count_if("has").alias("found"), F.count_if(F.col("version").isNotNull() & ~F.coalesce("has", F.lit(False)) & ~F.coalesce("none", F.lit(False))).alias("unknown"))
    return per.select("pkg", F.when(F.col("found") == F.col("n"), "complete").when(F.col("found") > 0, "partial").when(F.col("unknown") > 0, "unavailable").otherwise("none-published").alias("coverage"))


def spellings(pkg: Column, version: Column) -> Column:
    """Tags that a release of a version may have. Fixed values, in the order in which they are tried; a place in it is a repository's scheme."""
    bare = F.when(F.contains(pkg, F.lit("/")), F.split(pkg, "/")[1]).otherwise(pkg)
    at = lambda name: F.concat(name, F.lit("@"), version)
    dash = lambda name: F.concat(name, F.lit("-v"), version)
    return F.array(F.concat(F.lit("v"), version), version, at(pkg), at(bare), dash(pkg), dash(bare), F.concat(F.lit("release-"), version))


def tags(versions: DataFrame, tagged: DataFrame) -> DataFrame:
    """pkg, version, tag, scheme: the first spelling of a version that the repository has a tag for; null if none."""
    each = versions.select("pkg", "version", F.posexplode(spellings(F.col("pkg"), F.col("version"))).alias("scheme", "tag"))
    best = each.join(tagged.select("pkg", "tag").distinct(), ["pkg", "tag"]).groupBy("pkg", "version").agg(F.min_by(F.struct("tag", "scheme"), "scheme").alias("best"))
    return versions.select("pkg", "version").join(best, ["pkg", "version"], "left").select("pkg", "version", "best.tag", "best.scheme")


def lookups(versions: DataFrame, tagged: DataFrame, answers: DataFrame, most: int = 12) -> DataFrame:
    """pkg, version, asked array<string>, tag, failure, skipped: versions that a repository's first page of tags hasn't, asked for one tag after the other.

    tagged: pkg, tag of the page; answers: pkg, tag, outcome (found, or an error; tags without an answer aren't there). The first version that the page has teaches the
    package's scheme, which is all that is asked for then; before one is known the first three spellings are tried. A tag
    that is found, or an error, ends a version; once `most` tags have been asked the versions that follow are skipped.
    What was asked is summed over the versions in order, so the limit falls between versions.
    """
    found = tags(versions, tagged)
    learned = found.filter("tag is not null").groupBy("pkg").agg(F.min_by("scheme", semver.version_order("version")).alias("learned"))
    open_ = found.filter("tag is null").select("pkg", "version").join(learned, "pkg", "left")
    spelled = spellings(F.col("pkg"), F.col("version"))
    tries = F.when(F.col("learned").isNotNull(), F.array(F.get(spelled, F.col("learned")))).otherwise(F.slice(spelled, 1, 3))
    each = open_.select("pkg", "version", F.posexplode(tries).alias("at", "tag")).join(answers.groupBy("pkg", "tag").agg(F.min("outcome").alias("outcome")), ["pkg", "tag"], "left")
    told = each.groupBy("pkg", "version").agg(F.array_sort(F.collect_list(F.struct("at", "tag", "outcome"))).alias("tries"))  # three at most
    end = F.array_position(F.transform("tries", lambda t: t["outcome"].isNotNull()), True).cast("int")
    told = told.withColumn("asked", F.when(end > 0, F.slice("tries", F.lit(1), end)).otherwise(F.col("tries")))
    before = Window.partitionBy("pkg").orderBy(semver.version_order("version")).rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumns({"skipped": F.coalesce(F.sum(F.size("asked")).over(before), F.lit(0)) >= most, "last": F.try_element_at("asked", F.lit(-1))})
    live, ok = ~F.col("skipped"), F.col("last.outcome") == "found"
    asked = F.when(live, F.transform("asked", lambda t: t["tag"])).otherwise(F.array().cast("array<string>"))
    return told.select("pkg", "version", asked.alias("asked"), F.when(live & ok, F.col("last.tag")).alias("tag"), F.when(live & ~ok, F.col("last.outcome")).alias("failure"), "skipped")


def headings(bodies: DataFrame, key: str, text: str, dashes: int = 2) -> DataFrame:
    """key, row (a number of the body), pos, span, level, title of headings outside fences: # marks, and lines over `=` or `dashes` dashes and more."""
    own = graphs.written(bodies.select(key, F.col(text).alias("body")).withColumn("row", F.monotonically_increasing_id()), "bodies")
    each = own.select(key, "row", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line")).repartition("row")
    by = Window.partitionBy("row").orderBy("pos")
    told = lines.fenced(each, "row").withColumn("below", F.lead("line").over(by))
    pattern = r"^(#{1,6})\s+(.+?)\s*#*\s*\z"
    marks = F.regexp_extract("line", pattern, 1)
    under = F.when(F.col("below").rlike(r"^=+\s*\z"), 1).when(F.col("below").rlike(rf"^-{{{dashes},}}\s*\z"), 2)
    level = F.when(marks != "", F.length(marks)).when(F.col("line").rlike(T.WORD) & ~F.col("line").rlike(r"^\s*([-*+]|\d+\.)\s|^\s{4}"), under)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    found = told.filter(~F.col("in_fence") & ~fence).withColumns({"level": level, "marks": marks}).filter("level is not null")
    return found.select(key, "row", "pos", F.when(F.col("marks") != "", 1).otherwise(2).alias("span"), "level", F.when(F.col("marks") != "", F.regexp_extract("line", pattern, 2)).otherwise(F.trim("line")).alias("title"))


def sections(bodies: DataFrame, key: str, text: str) -> DataFrame:
    """key, version, first, last, of a changelog: from below a heading that names a version to the next of its level or above, or that names one.

    Of several sections of one version the first counts.
    """
    version = r"(?<![\d.])v?(\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?)(?![\d.])"
    heads = headings(bodies, key, text).withColumn("version", F.regexp_extract("title", version, 1))
    later = Window.partitionBy("row").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when((F.col("level") <= k) | (F.col("version") != ""), F.col("pos"))).over(later) for k in range(1, 7)]
    spans = heads.withColumn("end", F.get(F.array(*ends), F.col("level") - 1)).filter("version <> ''")
    rank = F.row_number().over(Window.partitionBy("row", "version").orderBy("pos"))
    first = spans.withColumn("rank", rank).filter("rank = 1").select(key, "version", (F.col("pos") + F.col("span")).alias("first"), "end")
    size = bodies.select(key, F.size(F.split(text, "\r?\n")).alias("n")).groupBy(key).agg(F.max("n").alias("n"))
    return first.join(size, key).select(key, "version", "first", (F.coalesce("end", "n") - 1).alias("last"))


def pointed(entries: DataFrame) -> DataFrame:
    """id, section: entries whose words send the reader to a section of their version, which has a body ("see ... X").

    entries: id, version, title, regions. What follows each "see" is cut at the ends of its words and meets titles by
    equality, no longer than the version's longest title.
    """
    words = T.plain_words(F.array_join(F.transform(F.filter("regions", lambda r: r["kind"].isin("title", "prose")), lambda r: r["text"]), " "))
    sections_ = entries.filter(F.exists("regions", lambda r: r["kind"] != "title")).select("version", F.col("id").alias("section"), T.plain_words(F.col("title")).alias("to")).filter(F.length("to") >= 4)
    longest = sections_.groupBy("version").agg(F.max(F.length("to")).alias("longest"))
    said = entries.select("version", "id", words.alias("words")).filter(F.col("words").rlike(r"(?<!\w)see ")).join(longest, "version")
    # all that follows each "see ", with and without "the "
    each = said.withColumn("parts", F.split("words", r"(?<!\w)see ")).select("version", "id", "longest", F.explode(F.transform(F.sequence(F.lit(2), F.size("parts")), lambda i: F.substring(F.array_join(F.slice(F.col("parts"), i, F.size("parts")), "see "), 1, 1 << 20))).alias("tail"))
    each = each.withColumn("tail", F.explode(F.array_distinct(F.array("tail", F.regexp_replace("tail", "^the ", "")))))
    ends = F.filter(F.sequence(F.lit(4), F.greatest(F.least(F.length("tail"), F.col("longest")), F.lit(4))), lambda k: (k <= F.length("tail")) & ~F.substr(F.col("tail"), k + 1, F.lit(1)).rlike(r"[\w-]"))
    cut = each.select("version", "id", F.explode(F.transform(ends, lambda k: F.substr(F.col("tail"), F.lit(1), k))).alias("to"))
    return cut.join(sections_, ["version", "to"]).filter("id <> section").select("id", "section").distinct()


def prereleases(published: DataFrame, stable: DataFrame, most: int = 20) -> DataFrame:
    """pkg, version, more: alpha, beta, rc, pre and preview versions of stable ones in range, the newest `most` of a package.

    more: how many of the package's are left out. Versions of other tags, dated ones among them, aren't wanted.
    """
    core = F.concat_ws(".", *[semver.part("version", k) for k in (1, 2, 3)])
    tag = F.split(semver.part("version", 4), r"\.")[0]
    early = published.filter(F.coalesce(tag.rlike(r"(?i)^(alpha|beta|rc|pre|preview)\z"), F.lit(False))).withColumn("of", core)
    early = early.join(stable.select("pkg", F.col("version").alias("of")).distinct(), ["pkg", "of"], "left_semi")
    by = Window.partitionBy("pkg")
    told = early.withColumns({"rank": F.row_number().over(by.orderBy(semver.key("version").desc())), "more": F.greatest(F.count(F.lit(1)).over(by) - most, F.lit(0))})
    return told.filter(F.col("rank") <= most).select("pkg", "version", "more")


def is_pointer(body: Column) -> Column:
    """A text that is empty without its addresses, or short and only sends the reader elsewhere."""
    plain = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?s)<!--.*?-->", "")
    plain = F.regexp_replace(plain, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    plain = F.regexp_replace(plain, f"https?://{T.WORD}+", "")
    plain = F.regexp_replace(plain, r"(?im)^\s*\**\s*full changelog\s*\**\s*:?.*$", "")
    plain = T.squeezed(F.regexp_replace(plain, "[*_#>`]", ""))
    elsewhere = r"(?i)change ?log|release notes|see |available (at|on|here)|upgrade guide|migration guide|blog post|details"
    return (plain == "") | ((F.length(plain) < 120) & plain.rlike(elsewhere))
