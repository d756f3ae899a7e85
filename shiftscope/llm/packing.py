"""Packing: optimal length buckets, and token-budget batches inside each bucket.

1. Lengths are counted once and written beside the columns that are asked for. Their histogram is global: a count
   for each length that occurs, of all documents. Different lengths of t tokens in all are at most sqrt(2 t), so its
   rows are few whatever the corpus.
2. Dynamic programming chooses `buckets` boundaries that minimise padding, each document padded to its bucket's
   boundary. The cost of a bucket from length i to j is linear in the counts below i for given j, so each layer
   is a lower hull of lines met in rising order: O(buckets x lengths), exact.
3. Documents are dealt by range of (bucket, doc_id), so a bucket that holds most of the corpus is many tasks'
   work. Ranks inside a bucket are a place in the partition plus a count of those before, a row for each
   partition and bucket; a batch holds floor(budget / boundary) documents, one at least.

A length is the number of words `[^\\x20\\x09-\\x0D]+`, one at least, so null and empty texts take a place of one
token. A document longer than the budget makes a batch of its own. Ties of doc_id are ordered by the text's hash; repeated rows are
each packed. Null doc_ids come first. An empty table gives an empty result. The columns asked for are carried as they
are, whatever their names; the five made here stand behind them. Bytes that aren't UTF-8 count as word characters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS, BUDGET = 16, 16_384


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """At most `buckets` rising boundaries, the last the greatest length, with the least padding.

    lengths rise. Of equally good sets the one is taken whose boundaries are smallest from the last but one down.
    """
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64)
    length = [int(x) for x in lengths]
    below = [0, *np.cumsum(counts, dtype=np.int64).tolist()]
    layers = min(buckets, n)
    # best[j]: least padded size of the first j lengths; the last bucket takes lengths i..j-1, padded to length[j-1]
    best: list[float] = [0, *([float("inf")] * n)]
    chosen: list[np.ndarray] = []
    for _ in range(layers):
        hull: list[int] = []
        at, following, came = 0, [float("inf")] * (n + 1), [0] * (n + 1)

        def meet(a: int, b: int, best=best) -> tuple[float, int]:
            # the line of b is no worse than that of a from length num / den on
            return best[b] - best[a], below[b] - below[a]

        for j in range(1, n + 1):
            new = j - 1
            if best[new] != float("inf"):
                while len(hull) - at >= 2:
                    p, d = meet(hull[-2], hull[-1])
                    q, e = meet(hull[-1], new)
                    if q * d <= p * e:
                        hull.pop()
                    else:
                        break
                hull.append(new)
            at = min(at, max(0, len(hull) - 1))
            x = length[j - 1]
            while at + 1 < len(hull):
                p, d = meet(hull[at], hull[at + 1])
                if p < x * d:
                    at += 1
                else:
                    break
            if hull:
                i = hull[at]
                following[j], came[j] = best[i] + x * (below[j] - below[i]), i
        chosen.append(np.array(came, np.int32))
        best = following
        best[0] = float("inf")
    # exactly `layers` buckets are never worse than fewer, as there are that many lengths
    out, j = [], n
    for came in reversed(chosen):
        out.append(length[j - 1])
        j = int(came[j])
    return np.array(out[::-1], np.int64)


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of a column __n."""
    found = lengths.groupBy("__n").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("__n")  # at most sqrt(2 x tokens) rows
    return found["__n"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def pack(docs: DataFrame, columns: list[str], length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """These columns of docs, then pack_tokens, pack_bucket, pack_length, pack_batch, pack_slot.

    pack_length is the bucket's boundary, pack_batch a batch's number in its bucket and pack_slot a document's in its batch.
    """
    spark = docs.sparkSession
    length = word_count() if length is None else length
    # the columns keep out of the way of those made here
    held, back = common.aside(docs, columns, F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), F.greatest(length, F.lit(1)).cast("long").alias("__n"))
    counted = held = common.written(held, "lengths", compression="zstd")
    lengths, counts = histogram(held)
    ends = boundaries(lengths, counts, buckets)
    bucket = F.lit(0)
    for k, end in enumerate(ends[:-1].tolist()):
        bucket = F.when(F.col("__n") > end, F.lit(k + 1)).otherwise(bucket)
    boundary = F.element_at(F.array(*[F.lit(x) for x in (ends.tolist() or [1])]), F.col("__bucket") + 1)
    held = held.withColumn("__bucket", bucket).withColumn("__tie", F.monotonically_increasing_id())
    by = [F.col("__bucket"), F.col("__id").asc_nulls_first(), F.col("__hash"), F.col("__tie")]
    ordered = held.repartitionByRange(common.shuffle_partitions(spark), *by).sortWithinPartitions(*by).drop("__hash", "__tie")
    placed = common.written(ordered.withColumn("__at", F.monotonically_increasing_id()), "packing", compression="zstd")
    common.dropped(counted)
    placed = placed.withColumn("__part", F.shiftrightunsigned("__at", 33))
    runs = placed.groupBy("__part", "__bucket").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__count"))
    offsets = _offsets(runs)
    # a row for each partition and each border of buckets: at most partitions + buckets
    rank = placed.join(F.broadcast(offsets), ["__part", "__bucket"]).withColumn("__rank", F.col("__at") - F.col("__first") + F.col("__before"))
    rank = rank.withColumn("__length", boundary.cast("long"))
    room = F.greatest(F.floor(F.lit(budget) / F.col("__length")), F.lit(1))
    return rank.select(
        *back,
        F.col("__n").alias("pack_tokens"),
        F.col("__bucket").alias("pack_bucket"),
        F.col("__length").alias("pack_length"),
        F.floor(F.col("__rank") / room).cast("long").alias("pack_batch"),
        F.pmod(F.col("__rank"), room).cast("long").alias("pack_slot"),
    )


def _offsets(runs: DataFrame) -> DataFrame:
    """Documents of the same bucket in earlier partitions."""
    before = Window.partitionBy("__bucket").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("__part", "__bucket", "__first", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"))
