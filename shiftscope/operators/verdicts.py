"""Verdicts: ordered rules, all that fire kept as reasons; what can't be seen is review, never quiet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = {"quiet": 0, "review": 1, "blocked": 2}


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """Codes of the rules that hold, in order; a rule that is null holds, as it could not be judged."""
    return F.filter(F.array(*[F.when(F.coalesce(flag, F.lit(True)), F.lit(code)) for code, flag in rules]), lambda x: x.isNotNull())


def verdict(codes: Column, blocking: str = "removed-touched") -> Column:
    return F.when(F.array_contains(codes, blocking), "blocked").when(F.size(codes) > 0, "review").otherwise("quiet")


def package_rules() -> list[tuple[str, Column]]:
    """The rules over one package's counts and states, a column each.

    Columns: removed, changed, deprecated, weak, matched, unattributed_breaking, unattributed_change, blind, opaque,
    refs, flagged, out_of_sync (counts; removed, changed and deprecated are strong uses); surface, notes, bump (states);
    incomplete (whether a computed surface may miss something: it stays computed, so what it proves removed blocks).
    """
    n = lambda c: F.col(c) > 0
    computed, complete = F.col("surface") == "computed", F.col("notes") == "complete"
    # The codes, in the order in which they are reported.
    clean = computed & complete & ~(n("removed") | n("changed") | n("deprecated") | n("weak") | n("matched") | n("unattributed_breaking") | n("unattributed_change"))
    return [
        ("removed-touched", computed & n("removed")),
        ("changed-touched", n("changed")),
        ("deprecated-touched", n("deprecated")),
        ("possibly-touched", n("weak")),
        ("notes-match", n("matched")),
        ("unattributed-breaking", n("unattributed_breaking")),
        ("unattributed-change", n("unattributed_change")),
        ("blind-spots", n("blind")),
        ("opaque-usage", n("opaque")),
        ("not-referenced", ~(n("refs") | n("opaque") | n("blind"))),
        ("flagged-install", n("flagged")),
        ("out-of-sync", n("out_of_sync")),
        ("surface-incomplete", F.col("surface").isin("failed", "offline-uncached", "types-elsewhere") | F.col("incomplete")),
        ("no-evidence", ~complete & ~computed),
        ("major-unproven", (F.col("bump") == "major") & ~clean),
    ]


def decide(packages: DataFrame) -> DataFrame:
    """packages with reasons and verdict; a quiet one is explained by what was clean or missing."""
    computed, complete = F.col("surface") == "computed", F.col("notes") == "complete"
    told = packages.withColumn("reasons", reasons(package_rules()))
    told = told.withColumn("verdict", verdict(F.col("reasons")))
    quiet = reasons([("notes-complete-no-match", complete), ("surface-clean", computed), ("caveat-no-types", ~computed), ("caveat-no-notes", ~complete)])
    return told.withColumn("reasons", F.when(F.col("verdict") == "quiet", quiet).otherwise(F.col("reasons")))


def worst(verdict_column: str) -> Column:
    """The worst verdict of a group."""
    rank = F.create_map(*[x for k, v in ORDER.items() for x in (F.lit(k), F.lit(v))])
    return F.max_by(F.col(verdict_column), rank[F.col(verdict_column)])


#: Verdicts from which a check fails, by its level.
FAILING = {"never": [], "blocked": ["blocked"], "review": ["review", "blocked"]}


def fails(verdict_column: Column, level: str = "blocked") -> Column:
    """Whether a check at a level fails on a verdict, of a package or the worst of many; no verdict, as where nothing has an update, never fails."""
    if level not in FAILING:
        raise ValueError(f"a level is one of {', '.join(FAILING)}, not {level!r}")
    return F.coalesce(verdict_column.isin(FAILING[level]), F.lit(False)) if FAILING[level] else F.lit(False)


def first_reason(rows: DataFrame, key: str, reason: str, place: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(reason, place).alias(reason))


def examples(rows: DataFrame, kind: str, order: str, what: str, most: int = 3) -> DataFrame:
    """kind, n, examples: how many there are and the first `most`.

    The rank keeps no more than `most` rows a group before the shuffle, as the limit stands on the window (Spark's group
    limit of windows); what is gathered is those few.
    """
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(kind).orderBy(order)))
    first = ranked.filter(F.col("__rank") <= most).groupBy(kind).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", what))), lambda s: s[what]).alias("examples"))
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).join(first, kind)
