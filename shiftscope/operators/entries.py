"""Release notes split into entries: a bullet with its nested lines, a heading with its body, or a stray paragraph.

Lines of a body are numbered and told apart by running counts and nearest values over one partitioning, by a row
number that `split` gives each body, so two bodies of one key never mix and a body travels once. A body's own lines are
all that meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graphs

LEVELS = range(1, 7)
_FENCE, _UNDER, _NESTED = r"^\s*(```|~~~)", r"^(=+|-{3,})\s*\z", r"^(\s+)[-*+]\s+(.*)\z"
_BULLET, _HEADING = r"^(\s{0,1})([-*+]|\d+[.)])\s+(.*)\z", r"^(#{1,6})\s+(.+?)\s*#*\s*\z"


def classified(bodies: DataFrame, key: str, text: str) -> DataFrame:
    """key, row (a number of the body), pos, line, what (fence, code, blank, heading, bullet or text), level, said (of headings and bullets)."""
    own = bodies.select(key, F.monotonically_increasing_id().alias("row"), T.prepared(F.coalesce(text, F.lit(""))).alias("__body"))
    each = own.select(key, "row", F.posexplode(F.split("__body", "\r?\n")).alias("pos", "line")).repartition("row")
    by = Window.partitionBy("row").orderBy("pos")
    line = F.col("line")
    told = each.withColumns({"fence": line.rlike(_FENCE), "below": F.lead("line").over(by)})
    before = F.coalesce(F.sum(F.col("fence").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = told.withColumn("code", before % 2 == 1)
    marks = F.regexp_extract("line", _HEADING, 1)
    open_ = ~F.col("fence") & ~F.col("code")
    # of lines in a row that each could be underlined, every second one is the underline of the one before
    could = open_ & (marks == "") & line.rlike(T.WORD) & F.coalesce(F.col("below").rlike(_UNDER), F.lit(False)) & ~line.rlike(r"^\s*[-*+]\s")
    told = told.withColumns({"marks": marks, "could": could})
    told = told.withColumn("since", F.last(F.when(~F.col("could"), F.col("pos")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("under", F.col("could") & ((F.col("pos") - F.coalesce("since", F.lit(-1))) % 2 == 1))
    told = told.withColumn("taken", F.coalesce(F.lag("under").over(by), F.lit(False)))
    level = F.when(F.col("marks") != "", F.length("marks")).when(F.col("under"), F.when(F.startswith("below", F.lit("=")), 1).otherwise(2))
    bullet = F.col("line").rlike(_BULLET)
    what = (
        F.when(F.col("taken"), "taken").when(F.col("fence"), "fence").when(F.col("code"), "code").when(level.isNotNull(), "heading")
        .when(~F.col("line").rlike(T.WORD), "blank").when(bullet, "bullet").otherwise("text")
    )
    said = F.when(F.col("marks") != "", F.regexp_extract("line", _HEADING, 2)).when(F.col("under"), F.trim("line")).when(bullet, F.regexp_extract("line", _BULLET, 3))
    return told.select(key, "row", "pos", "line", what.alias("what"), F.when(what == "heading", level).alias("level"), T.cleaned(said).alias("said")).filter("what <> 'taken'")


def _drafts(lines: DataFrame, key: str) -> DataFrame:
    """lines with entry (a running number), kind, title, path of their entry, and part: whether the line is of its content."""
    by = Window.partitionBy("row").orderBy("pos")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("what").isin("heading", "bullet")
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    outside = F.when(F.col("what").isin("blank", "text", "heading", "bullet"), F.col("what"))
    told = lines.withColumns({"seg": F.sum(head.cast("int")).over(upto), "last": F.last(outside, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))})
    segment = Window.partitionBy("row", "seg").orderBy("pos")
    told = told.withColumn("under", F.when(F.col("seg") > 0, F.first("what").over(segment)))
    loose = (F.col("what") == "text") & (F.col("under") == "bullet") & (indent < 2) & (F.col("last") == "blank")
    first = F.col("under").isNull() & F.col("what").isin("text", "fence")
    told = told.withColumn("could", F.coalesce(loose | first, F.lit(False)))
    earlier = F.coalesce(F.sum(F.col("could").cast("int")).over(segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = told.withColumn("start", head | (F.col("could") & (earlier == 0)))
    # headings above: of each level the last, if none of a lower level came after it
    for level in LEVELS:
        told = told.withColumn(f"h{level}", F.last(F.when(F.col("level") == level, F.struct(F.col("pos").alias("at"), F.col("said").alias("title"))), ignorenulls=True).over(upto))
    lives = lambda n: F.forall(F.array(F.lit(-1), *[F.coalesce(F.col(f"h{k}.at"), F.lit(-1)) for k in LEVELS if k < n]), lambda p: p < F.col(f"h{n}.at")) & (F.coalesce("level", F.lit(7)) > n)
    path = F.filter(F.array(*[F.when(F.coalesce(lives(n), F.lit(False)), F.col(f"h{n}.title")) for n in LEVELS]), lambda x: x.isNotNull())
    kind = F.when(F.col("start"), F.when(head, F.col("what")).otherwise("paragraph"))
    title = F.when(head, F.col("said")).when(F.col("what") == "fence", T.first_words(F.col("line"))).otherwise(T.first_sentence(F.col("line")))
    told = told.withColumns({"entry": F.sum(F.col("start").cast("int")).over(upto), "kind": kind, "title": F.when(F.col("start"), title), "path": F.when(F.col("start"), path)})
    part = F.col("what").isin("code", "text")
    return told.select(key, "row", "pos", "line", (F.col("what") == "code").alias("code"), "entry", "kind", "title", "path", part.alias("part")).filter("entry > 0")


def _held(drafts: DataFrame, by: list[str]) -> DataFrame:
    """One row an entry, with its lines in order."""
    line = F.when(F.col("part"), F.struct("pos", F.col("line").alias("text"), "code"))
    first = lambda c: F.min_by(c, "pos").alias(c)
    return drafts.groupBy(*by).agg(first("kind"), first("title"), first("path"), F.array_sort(F.collect_list(line)).alias("lines"))  # no more than a body has


def _expanded(entries: DataFrame, key: str) -> DataFrame:
    """A bullet that ends in a colon as its nested items, the label behind their path; what comes before them stays its own."""
    nested = F.filter("lines", lambda x: ~x["code"] & x["text"].rlike(_NESTED))
    indent = lambda t: F.length(F.regexp_extract(t, r"^(\s*)", 1))
    label = (F.col("kind") == "bullet") & F.col("title").rlike(r":\s*\z") & (F.size(nested) > 0)
    told = entries.withColumn("top", F.when(label, F.array_min(F.transform(nested, lambda x: indent(x["text"])))))
    item = lambda x: ~x["code"] & x["text"].rlike(_NESTED) & (indent(x["text"]) == F.col("top"))
    starts = F.filter(F.transform("lines", lambda x, i: F.when(item(x), i)), lambda i: i.isNotNull())
    child = lambda i, n: F.struct(
        i.alias("child"),
        F.when(i == 0, F.col("title")).otherwise(T.cleaned(F.regexp_extract(F.get("lines", F.get("starts", i - 1))["text"], _NESTED, 2))).alias("title"),
        F.when(i == 0, F.col("path")).otherwise(F.array_append("path", F.trim(F.regexp_replace("title", r":\s*\z", "")))).alias("path"),
        F.slice("lines", F.coalesce(F.get("starts", i - 1) + 2, F.lit(1)), F.greatest(F.coalesce(F.get("starts", i), n) - F.coalesce(F.get("starts", i - 1) + 1, F.lit(0)), F.lit(0))).alias("lines"),
    )
    told = told.withColumn("starts", F.when(F.col("top").isNotNull(), starts).otherwise(F.array().cast("array<int>")))
    parts = F.transform(F.sequence(F.lit(0), F.size("starts")), lambda i: child(i, F.size("lines")))
    each = told.select(key, "row", "entry", "kind", "top", F.explode(parts).alias("p"))
    said = F.exists("p.lines", lambda x: x["text"].rlike(T.WORD))
    kept = each.filter(F.col("top").isNull() | (F.col("p.child") > 0) | said)
    return kept.select(key, "row", "entry", "p.child", "kind", "p.title", "p.path", "p.lines").filter((F.col("title") != "") | F.exists("lines", lambda x: x["text"].rlike(T.WORD)))


def _regions(title: Column, lines: Column) -> Column:
    """An entry's regions: the title's, then each line's, examples in a row as one."""
    none = F.array().cast(T.REGIONS)
    # lines as groups: code in a row is one text, any other line its own
    joined = F.aggregate(
        lines,
        F.array().cast("array<struct<text:string,code:boolean>>"),
        lambda acc, x: F.when(
            x["code"] & F.coalesce(F.try_element_at(acc, F.lit(-1))["code"], F.lit(False)),
            F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(F.concat(F.try_element_at(acc, F.lit(-1))["text"], F.lit("\n"), x["text"]).alias("text"), F.lit(True).alias("code"))),
        ).otherwise(F.array_append(acc, F.struct(x["text"].alias("text"), x["code"].alias("code")))),
    )
    of_line = lambda x: F.when(x["code"], F.array(F.struct(F.lit("code-block").alias("kind"), x["text"].alias("text")))).otherwise(T.text_regions(T.cleaned(x["text"]), "prose"))
    return F.concat(F.coalesce(T.text_regions(title, "title"), none), F.flatten(F.transform(joined, of_line)))


def split(bodies: DataFrame, key: str, version: str, text: str) -> DataFrame:
    """key, version, ord, id, title, heading_path, regions, breaking, kind, noise, refs of all entries of all bodies.

    Null bodies have none. Entries that a fuller one of the same body covers by its numbers are left out, as are bullets
    that only say a heading of the body again.
    """
    own = bodies.select(F.struct(F.col(key).alias("key"), F.col(version).alias("version")).alias("of"), F.col(text).alias("__text"))
    drafts = _held(_drafts(classified(own, "of", "__text"), "of"), ["of", "row", "entry"]).filter("kind <> 'heading' or size(lines) > 0")
    found = _expanded(drafts, "of")
    by = Window.partitionBy("row").orderBy("entry", "child")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = found.withColumns({"at": F.row_number().over(by) - 1, "n": F.count(F.lit(1)).over(whole)})
    told = told.withColumn("listed", F.min(F.when(F.col("kind") != "paragraph", F.col("at"))).over(whole))
    told = told.withColumn("intro", (F.col("listed") > 0) & (F.col("n") - F.col("listed") >= 2) & (F.col("at") < F.col("listed")))
    plain = T.normalized_title(F.col("title"))
    titles = F.collect_set(F.when((F.col("kind") == "heading") & (F.length(plain) >= 3), plain)).over(whole)  # of one body
    told = told.withColumns({"plain": plain, "titles": titles})
    told = told.filter((F.col("kind") != "bullet") | ~F.exists("titles", lambda h: T.starts_with_title(F.col("plain"), h))).withColumn("ord", F.row_number().over(by) - 1)
    every = F.concat_ws("\n", F.array("title"), F.transform("lines", lambda x: x["text"]))
    told = told.withColumns({"regions": _regions(F.col("title"), F.col("lines")), "whole": every})
    shown = F.regexp_replace("title", "`", "")
    out = told.select(
        F.col("of.key").alias(key), F.col("of.version").alias(version), "row", "ord",
        F.substring(F.sha1(F.concat_ws("\u0000", F.coalesce(F.col("of.version").cast("string"), F.lit("")), F.col("ord").cast("string"), "whole")), 1, 12).alias("id"),
        F.when(F.length(shown) > 200, F.concat(F.substring(shown, 1, 197), F.lit("..."))).otherwise(shown).alias("title"),
        F.col("path").alias("heading_path"), "regions", T.is_breaking(F.col("title"), F.col("path")).alias("breaking"),
        T.entry_kind(F.col("title"), F.col("whole"), F.col("regions"), F.col("path"), F.coalesce("intro", F.lit(False))).alias("kind"), T.references(F.col("whole")).alias("refs"),
    )
    # written, as the numbers of bodies must not change between the joins that follow
    out = graphs.written(out.withColumn("noise", F.col("kind") == "housekeeping"), "entries")
    return without_covered(out).drop("row")


def without_covered(entries: DataFrame) -> DataFrame:
    """entries (row, ord, regions, refs, noise) without those that say no more than their numbers, where others say more.

    An entry goes if all its numbers stand in entries with a body of their own, it has nothing but a title and code spans,
    and one entry with more regions has all its numbers.
    """
    thin = ~F.exists("regions", lambda r: ~r["kind"].isin("title", "inline-code")) & (F.size("refs") > 0)
    body = F.exists("regions", lambda r: r["kind"] != "title")
    each = entries.withColumn("n_regions", F.size("regions")).select("row", "ord", "n_regions", F.size("refs").alias("n_refs"), thin.alias("thin"), (~F.col("noise") & body).alias("full"), F.explode("refs").alias("ref"))
    covered = each.filter("full").select("row", "ref").distinct()
    open_ = each.filter("thin").select("row", "ord", "n_regions", "n_refs", "ref")
    told = open_.join(covered, ["row", "ref"]).groupBy("row", "ord").agg(F.count(F.lit(1)).alias("n"), F.max("n_refs").alias("n_refs")).filter("n = n_refs").select("row", "ord")
    others = each.select("row", F.col("ord").alias("other"), F.col("n_regions").alias("more"), "ref")
    shadowed = open_.join(others, ["row", "ref"]).filter("other <> ord and more > n_regions").groupBy("row", "ord", "other").agg(F.count(F.lit(1)).alias("n"), F.max("n_refs").alias("n_refs")).filter("n = n_refs").select("row", "ord").distinct()
    return entries.join(told.join(shadowed, ["row", "ord"]), ["row", "ord"], "left_anti")
