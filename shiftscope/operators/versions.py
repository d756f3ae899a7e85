"""Versions: the candidate of an upgrade, and the pairing of two snapshots.

Tables:

* releases: pkg string, version string, published_at timestamp, deprecated boolean;
* installed: pkg string, version string;
* snapshots: name, manifest, key, version string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semver


def candidates(installed: DataFrame, releases: DataFrame, latest: DataFrame, now: Column, least_age_days: int = 0) -> DataFrame:
    """pkg, version, target, bump, held_back (newer versions that were passed over, with reasons, three at most), also.

    latest: pkg, latest (the tag). Deprecated and undated versions are never chosen, nor those younger than the
    least age; the target stays on the installed version's caret line and never above the tag; `also` is the
    newest version beyond that line. A package without releases stays, with null target.
    """
    met = installed.alias("i").join(releases.select("pkg", F.col("version").alias("v"), "published_at", F.coalesce("deprecated", F.lit(False)).alias("deprecated")), "pkg", "left").join(latest, "pkg", "left")
    newer = semver.is_stable("v") & (semver.key("v") > semver.key("version"))
    young = F.col("published_at") > now - F.expr(f"interval {least_age_days} days")
    line, beyond_tag = semver.same_line("version", "v"), semver.key("v") > semver.key("latest")
    tagged = F.coalesce(semver.same_line("version", "latest"), F.lit(False)) & F.coalesce(beyond_tag, F.lit(False))
    why = F.when(~F.coalesce(newer, F.lit(False)), "older").when(F.col("deprecated"), "deprecated").when(F.col("published_at").isNull(), "undated").when(young, "too-new").when(line & tagged, "above-dist-tag").when(line, "ok").otherwise("beyond")
    told = met.withColumns({"why": why, "k": semver.key("v")})
    pick = lambda kind: F.max_by("v", F.when(F.col("why") == kind, F.col("k")))
    out = told.groupBy("pkg", "version").agg(
        pick("ok").alias("best"),
        F.bool_or(F.col("why") == "ok").alias("some"),
        pick("beyond").alias("next"),
        F.bool_or(F.col("why") == "beyond").alias("more"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("why").isin("deprecated", "too-new", "above-dist-tag"), F.struct("k", F.col("v").alias("version"), F.col("why").alias("reason")))))).alias("skipped"),
    )
    target = F.when(F.col("some"), F.col("best"))
    over = F.filter("skipped", lambda s: target.isNull() | (s["k"] > semver.key(target)))
    return out.select(
        "pkg",
        "version",
        target.alias("target"),
        F.when(target.isNotNull(), semver.bump("version", target)).alias("bump"),
        F.transform(F.slice(over, 1, 3), lambda s: F.struct(s["version"].alias("version"), s["reason"].alias("reason"))).alias("held_back"),
        F.when(F.col("more"), F.col("next")).alias("also"),
    )


def plan(now: DataFrame, base: DataFrame) -> DataFrame:
    """name, manifest, key, version, before, state: changed, unchanged or added, by (name, manifest, key).

    Of several earlier versions the lowest is compared; any equal one means unchanged.
    """
    on = ["name", "manifest", "key"]
    earlier = base.groupBy(*on).agg(F.min_by("version", semver.version_order("version")).alias("before"), F.collect_set("version").alias("all"))
    met = now.join(earlier, on, "left")
    state = F.when(F.col("before").isNull(), "added").when(F.array_contains("all", F.col("version")), "unchanged").otherwise("changed")
    return met.select(*on, "version", "before", state.alias("state"))


def newest_per(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)
