"""Lines of diffs, notes and code: runs, fences, multiset matches.

Tables: lines (file, side, line int, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def runs(lines: DataFrame, by: list[str], place: str) -> DataFrame:
    """by, first, last, n: consecutive places as one row, gaps end a run."""
    own = lines.select(*by, place).distinct()
    island = own.withColumn("island", F.col(place) - F.row_number().over(Window.partitionBy(*by).orderBy(place)))
    return island.groupBy(*by, "island").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def split_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line of every text."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


def fenced(lines: DataFrame, key: str) -> DataFrame:
    """lines with in_fence: whether an odd number of fences came before."""
    fence = F.col("line").rlike(r"^\s*(```|~~~)").cast("int")
    before = F.coalesce(F.sum(fence).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("in_fence", before % 2 == 1)


def fence_counts(text: Column) -> Column:
    """A struct of lines and fenced (those with an odd number of fences before them) of a text, within its row."""
    step = lambda acc, line: F.struct((acc["open"] != line.rlike(r"^\s*(```|~~~)")).alias("open"), (acc["fenced"] + acc["open"].cast("long")).alias("fenced"))
    parts = F.split(text, "\n")
    counted = F.aggregate(parts, F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("fenced")), step)
    return F.struct(F.size(parts).cast("long").alias("lines"), counted["fenced"].alias("fenced"))


def reformatted(removed: DataFrame, added: DataFrame, least: int = 6) -> DataFrame:
    """id, file, line of removed lines that only changed layout: written again in the file as a multiset, or, with the
    removed lines beside them, a part of what the file gains, layout apart and `least` characters long.

    removed, added: id, file, line, text. Of equal removed lines the first are those written again. A file's own gained
    text is all that a run is looked for in.
    """
    by = ["id", "file"]
    own = removed.select(*by, "line", T.layout_free(F.col("text")).alias("same"))
    new = added.select(*by, "line", T.layout_free(F.col("text")).alias("same"))
    pool = new.filter("same <> ''").groupBy(*by, "same").agg(F.count(F.lit(1)).alias("pool"))
    place = F.row_number().over(Window.partitionBy(*by, "same").orderBy("line"))
    told = own.withColumn("place", place).join(pool, [*by, "same"], "left").withColumn("again", F.coalesce(F.col("place") <= F.col("pool"), F.lit(False)))
    rest = told.filter("not again")
    island = F.col("line") - F.row_number().over(Window.partitionBy(*by).orderBy("line", "same"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("line", "same"))), lambda x: x["same"])
    run = rest.withColumn("island", island).groupBy(*by, "island").agg(F.array_join(pieces, "").alias("joined"), F.collect_list("line").alias("places"))
    gained = new.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "same"))), lambda x: x["same"]), "").alias("gained"))
    inside = run.join(gained, by).filter((F.length("joined") >= least) & F.contains("gained", F.col("joined"))).select(*by, F.explode("places").alias("line"))
    return told.filter("again").select(*by, "line").unionByName(inside)


def moved(lines: DataFrame, gone: Column, by: list[str]) -> DataFrame:
    """by, same, pairs: lines equal but for their layout on both sides, as a multiset: the smaller count of each.

    gone: whether a line is of the old side. Both sides are counted in one pass.
    """
    same = lines.select(*by, T.layout_free(F.col("text")).alias("same"), gone.alias("gone")).filter("same <> ''")
    counts = same.groupBy(*by, "same").agg(F.count_if("gone").alias("a"), F.count_if(~F.col("gone")).alias("b"))
    return counts.filter("a > 0 and b > 0").select(*by, "same", F.least("a", "b").alias("pairs"))


def followups(starts: DataFrame, later: DataFrame, key: str, days: int = 14, most: int = 10) -> DataFrame:
    """key, id, at, next_id, next_at, rank: the first `most` later events of a key within `days` of each start, itself not among them.

    The interval is cut into slots of its own length; an event lies in its slot or the one before, so the join is by
    equality on (key, slot) and a key's history never meets itself whole.
    """
    length = days * 86_400_000_000
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / length)
    a = starts.select(key, "id", "at", F.explode(F.array(slot("at"), slot("at") + 1)).alias("slot"))
    b = later.select(key, F.col("id").alias("next_id"), F.col("at").alias("next_at"), slot("at").alias("slot"))
    met = a.join(b, [key, "slot"]).filter((F.col("next_id") != F.col("id")) & (F.col("next_at") >= F.col("at")) & (F.col("next_at") < F.col("at") + F.expr(f"interval {days} days")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("next_at", "next_id"))
    return met.select(key, "id", "at", "next_id", "next_at", rank.alias("rank")).filter(F.col("rank") <= most)


def adapting_followups(upgrades: DataFrame, commits: DataFrame, touched: DataFrame, days: int = 14, most: int = 10) -> DataFrame:
    """id, pkg, next_id, rank: later commits within `days` of an upgrade, the first `most` of its repository, that adapt code to it.

    upgrades: repo, id, at, pkg; commits: repo, id, at, subject; touched: id, pkg (packages that a commit's changed source files
    import). One adapts code if it names the package, without its scope, as a word, or says that it reverts, and has such files. Slots
    of time bring an upgrade and its commits together; words and files then meet by equality.
    """
    starts = upgrades.select("repo", "id", "at").distinct()
    near = followups(starts, commits, "repo", days, most).select("repo", "id", "next_id", "rank")
    met = near.join(upgrades.select("repo", "id", "pkg").distinct(), ["repo", "id"])
    changed = met.join(touched.select(F.col("id").alias("next_id"), "pkg").distinct(), ["next_id", "pkg"], "left_semi")
    said = changed.join(commits.select("repo", F.col("id").alias("next_id"), "subject"), ["repo", "next_id"])
    short = F.regexp_replace(F.regexp_extract("pkg", r"([^/]+)\z", 1), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    names = F.rlike("subject", F.concat(F.lit(r"(?i)\b"), short, F.lit(r"\b|revert")))
    return said.filter(names).select("id", "pkg", "next_id", "rank")
