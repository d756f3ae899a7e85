"""Scores: what was expected against what was reported, per case, per set and in all.

Tables: expected (case, file, line); reported (case, package, file, line, verdict).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from . import graphs


def per_case(expected: DataFrame, reported: DataFrame) -> DataFrame:
    """case, expected, found, wrong_quiet, reported: lines found are lines of both."""
    want = expected.select("case", "file", "line").distinct()
    got = reported.filter("line is not null").select("case", "file", "line").distinct()
    found = want.join(got, ["case", "file", "line"], "left_semi").groupBy("case").agg(F.count(F.lit(1)).alias("found"))
    loud = reported.groupBy("case").agg(F.bool_and(F.col("verdict") == "quiet").alias("wrong_quiet"), F.count("line").alias("reported"))
    return want.groupBy("case").agg(F.count(F.lit(1)).alias("expected")).join(found, "case", "left").join(loud, "case", "left").select("case", "expected", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("wrong_quiet", F.lit(False)).alias("wrong_quiet"), F.coalesce("reported", F.lit(0)).alias("reported"))


def totals(cases: DataFrame, sets: list[str]) -> DataFrame:
    """Cases, found, wrong quiets, median and pooled precision of each set, and of all (sets null).

    cases: found, reported (counts), wrong_quiet boolean and the set columns. Precision pools counts over cases.
    """
    return cases.groupingSets([[*sets], []], *sets).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("found") > 0).alias("found_cases"),
        F.count_if("wrong_quiet").alias("wrong_quiet"),
        numbers.median(F.col("reported")).alias("median_reported"),
        F.round(numbers.share(F.sum("found"), F.sum("reported")), 4).alias("precision"),
    )


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, median (the mean of the middle two) and upper_median (the upper of them) of values that aren't null.

    Equal values meet as counts first; the counts are dealt by range of (key, value), so a key of most rows is many
    tasks' work, and a value's rank is its place in the partition plus what lies before, a row a partition and key.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ordered = counts.repartitionByRange("k", "v").sortWithinPartitions("k", "v").withColumn("at", F.monotonically_increasing_id())
    placed = graphs.written(ordered, "ranked").withColumn("part", F.shiftrightunsigned("at", 33))
    per = placed.groupBy("part", "k").agg(F.sum("c").alias("here"))
    by = Window.partitionBy("k").orderBy("part")
    offsets = per.select("part", "k", (F.sum("here").over(by) - F.col("here")).alias("before"), F.sum("here").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    inside = F.sum("c").over(Window.partitionBy("part", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("upto", inside).join(offsets.withColumnRenamed("k", "of"), [placed["part"] == offsets["part"], F.col("k").eqNullSafe(F.col("of"))])
    last = F.col("before") + F.col("upto")
    holds = lambda rank: (last >= rank) & (last - F.col("c") < rank)
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    found = ranked.filter(holds(lower) | holds(upper)).groupBy("k").agg(F.max("n").alias("n"), ((F.min("v") + F.max("v")) / 2).alias("median"), F.max("v").alias("upper_median"))
    return found.select(F.col("k").alias(key), "n", "median", "upper_median")
