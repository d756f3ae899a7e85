"""Filter interaction audit: what each filter of a chain removes, in every order, from one CUBE over failure flags.

`measured` and `failures` give each document its flags: A too few words, B too many repeated ones, C too many capitals, D a symbol that
marks code or tables, E a text that a smaller doc_id has too. `audit` counts documents by (part, flags) before anything
else, takes the CUBE of those few rows, and reads the survivors of a set of filters off the grouping set of that
set's flags, all false. A step of an order is a pair of sets, before and after its filter: what it removes is the
difference of their survivors. Counts are whole: all documents, all orders, all steps, zeros included.

Texts meet by a SHA-256 of their content; the smallest doc_id of each is found by a partial aggregate, so that a group of
copies of any size is a row a task, and a document is held against it by (doc_id, hash): no group of copies is gathered.
Null texts count as empty, null parts as the empty string. A null doc_id is no smaller than any, nor any than it: such rows never
fail E, have no labels, and stay apart from joins. Rows that share the smallest doc_id and text fail E none of them. Several label rows of
one doc_id count as one with any of their flags. An empty table gives no part, so no row. Other columns aren't read.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = "ABCDE"
_SPACES = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.array_remove(F.split(text, _SPACES), "")


def text_flags(text: Column) -> dict[str, Column]:
    """A to D of a text column without nulls."""
    words = word_list(text)
    n_words, n_different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n_words < 100,
        "B": 100 * n_different.cast("long") < 80 * n_words.cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """A written table of doc_id, part, the flags A to D and the hash of every text (doc_id, text, lang): a few bytes a row."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    own = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("content"), *[c.alias(k) for k, c in text_flags(F.col("text")).items()])
    return common.written(own, "failures")


def failures(own: DataFrame) -> DataFrame:
    """doc_id, part and the flags A to E of every measured row."""
    named = own.filter(F.col("doc_id").isNotNull())
    firsts = named.groupBy("content").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    held = named.join(firsts, ["doc_id", "content"], "left").withColumn("E", F.col("first").isNull())
    unnamed = own.filter(F.col("doc_id").isNull()).withColumn("E", F.lit(False))
    return held.select("doc_id", "part", *LETTERS).unionByName(unnamed.select("doc_id", "part", *LETTERS))


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """flags with good and toxic (0 or 1) from labels (doc_id, quality, toxic)."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    named = flags.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    return named.unionByName(flags.filter(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def survivors(flagged: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, chosen (bit k: filter k is applied), n, good and toxic of what passes; part null for all parts at once.

    The CUBE has a grouping set for each set of flags, with and without part; its row with all of them false is what
    no chosen filter removes. Sets that nothing passes have no row.
    """
    counted = flagged.groupBy("part", *letters).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cubed = counted.cube("part", *letters).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.grouping("part").alias("all_parts"), *[F.grouping(k).alias(f"all_{k}") for k in letters])
    passed = [(F.col(f"all_{k}") == 1) | ~F.col(k) for k in letters]
    kept = cubed
    for condition in passed:
        kept = kept.filter(condition)
    chosen = sum(((1 - F.col(f"all_{k}")) * (1 << i) for i, k in enumerate(letters)), F.lit(0))
    return kept.select("part", F.col("all_parts").cast("boolean").alias("all_parts"), chosen.cast("int").alias("chosen"), "n", "good", "toxic")


def steps(letters: str = LETTERS) -> list[tuple[str, int, str, int, int]]:
    """Every order of the filters, step by step: (filter_order, step, letter, set before, set after)."""
    out = []
    for order in permutations(letters):
        before = 0
        for i, letter in enumerate(order, 1):
            after = before | 1 << letters.index(letter)
            out.append(("".join(order), i, letter, before, after))
            before = after
    return out


def audit(survived: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row a part, order and step, from the (written) survivors of every set.

    Survivors of both sets of each step meet by (part, set): a row a pair of sets, 5 * 2^4 a part. Orders are a table
    of 600 rows for five filters, whatever the input, and are broadcast; so is nothing else.
    """
    spark = survived.sparkSession
    passed = survived.filter("not all_parts").drop("all_parts")  # at most 2^5 rows a part
    everything = (1 << len(letters)) - 1
    pairs = [(letter, before, before | 1 << i, math.factorial(before.bit_count()) * math.factorial(len(letters) - 1 - before.bit_count())) for i, letter in enumerate(letters) for before in range(1 << len(letters)) if not before >> i & 1]
    values = F.array(*[F.struct(F.lit(a).alias("letter"), F.lit(b).alias("before"), F.lit(c).alias("after"), F.lit(w).alias("orders")) for a, b, c, w in pairs])
    parts = passed.filter("chosen = 0").select("part", F.inline(values))

    def of(name: str) -> DataFrame:
        return passed.select("part", F.col("chosen").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "good", "toxic")])

    met = parts.join(of("before"), ["part", "before"], "left").join(of("after"), ["part", "after"], "left").na.fill(0)
    met = met.withColumn("removed", F.col("n_before") - F.col("n_after"))
    # of a filter: removed by it first, alone against all others, and over all orders
    own = met.groupBy("part", "letter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("after") == everything, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    plan = spark.createDataFrame(steps(letters), "filter_order string, step int, letter string, before int, after int")
    found = met.join(F.broadcast(plan), ["letter", "before", "after"]).join(own, ["part", "letter"])
    return found.select(
        "part",
        "filter_order",
        "step",
        F.col("n_after").alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        (F.col("good_before") - F.col("good_after")).alias("good_lost"),
        (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
        "shapley",
    )
