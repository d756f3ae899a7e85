"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to `ORDERS` characters of the lower-cased text, white space folded to one
space, a space before and after) by language and bucket; the counts are summed by Spark and smoothed into a matrix of
log probabilities, `BUCKETS` x languages. The matrix is broadcast by groups of GROUP languages, so that a broadcast and
what the driver reads at once are bounded; each group is one more pass of the scoring, in the same stage. Scoring takes
a block of texts as one sparse matrix of bucket hits, texts by rows, and sums the log probabilities of its rows in
numpy, some PIECE hits at a time. Whole texts are read, and a long text has the n-grams that a short one has.

The training sample is bounded: at most about `SAMPLE` documents of each language, chosen by a hash of doc_id
and text, the same at every size of cluster; languages with fewer give all.

`score` is the posterior probability of the predicted language under a length-normalised likelihood, between 0
and 1. Texts that are null or have no letter get `und` and 0.0; so do all texts where nothing could be learned. Ties go to
the alphabetically first language. Rows with null doc_id are predicted as others are; repeated rows give
repeated results. Null languages aren't learned from. An empty table gives an empty result. Columns besides doc_id,
text and lang are carried as they are, whatever their names; the two results are named by the caller.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, ORDERS = 1 << 16, 3
SAMPLE = 20_000
#: Languages whose columns of the matrix are broadcast together.
GROUP = 64
SMOOTHING = 0.5
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]").search
_SPACES = re.compile(r"\s+")
#: Odd multipliers of the n-gram hash, one for each place.
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
#: Characters hashed at once, and numbers of the matrix summed at once.
_PIECE, _SUMMED = 1 << 18, 1 << 20


def _has_letter(text: str) -> bool:
    """A character of Unicode category L; the pattern also passes some marks and numbers."""
    found = _LETTER(text)
    return bool(found) and (found.group().isalpha() or any(c.isalpha() for c in text))


def ngram_hits(texts: list[str], piece: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of the texts and which text each is of, rising, in pieces of bounded size."""
    folded = [_SPACES.sub(" ", f" {x.lower()} ") for x in texts]
    sizes = np.fromiter(map(len, folded), np.int64, len(folded))
    code = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = sizes.cumsum()
    for start in range(0, len(code), piece):
        stop = min(len(code), start + piece)
        own = code[start : stop + ORDERS - 1]
        first, last = np.searchsorted(ends, (start, stop - 1), side="right")
        inside = np.minimum(ends[first : last + 1], stop) - np.maximum(ends[first : last + 1] - sizes[first : last + 1], start)
        text = np.repeat(np.arange(first, last + 1), inside)
        for n in range(1, ORDERS + 1):
            count = min(stop - start, len(own) - n + 1)
            if count <= 0:
                continue
            h = own[:count] * _MULTIPLIERS[0] + np.uint32(n)
            for k in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * _MULTIPLIERS[k] + own[k : count + k]
            h ^= h >> np.uint32(13)
            h *= _MULTIPLIERS[4]
            h >>= np.uint32(32 - 16)
            # a text's last places begin no n-gram of n
            gone = (ends[first : last + 1, None] - np.arange(1, n)).ravel() - start
            gone = gone[(gone >= 0) & (gone < count)]
            yield np.delete(h, gone), np.delete(text[:count], gone)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for block in common.blocks(batches, most=2 << 20):
        langs = block.column("lang").to_pylist()
        known = list(dict.fromkeys(langs))
        which = np.array([known.index(x) for x in langs], np.int64)
        for bucket, text in ngram_hits(common.texts(block.column("text"))):
            of = which[text]
            for i in np.unique(of).tolist():
                counts[known[i]] = counts.get(known[i], 0) + np.bincount(bucket[of == i], minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        table = pa.table({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(own[at])})
        yield from table.to_batches(max_chunksize=20_000)


class Model:
    """Groups of languages, in order, each with its columns of the matrix."""

    def __init__(self, groups: list[tuple[list[str], np.ndarray]]):
        self.groups = groups


def mean_scores(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """(texts, languages): mean log probability of each text's n-grams."""
    total, n = np.zeros((len(texts), logs.shape[1])), np.zeros(len(texts), np.int64)
    for bucket, text in ngram_hits(texts):
        n += np.bincount(text, minlength=len(texts))
        step = max(1024, _SUMMED // logs.shape[1])
        for i in range(0, len(bucket), step):
            rows = text[i : i + step]
            heads = np.flatnonzero(np.diff(rows, prepend=-1))
            total[rows[heads]] += np.add.reduceat(logs.take(bucket[i : i + step], axis=0), heads, axis=0, dtype=np.float64)
    return total / np.maximum(n, 1)[:, None]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from columns doc_id, text, lang; other columns are not read."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    over = [(k, sample / n) for k, n in sizes.items() if n > sample]
    if over:
        # a hash's place among all 2 ** 64 against the share, null where all rows are taken
        upto = F.create_map(*[F.lit(x) for lang, part in over for x in (lang, int(part * 2**64) - 2**63)])[F.col("lang")]
        rows = rows.filter(F.coalesce(F.xxhash64("doc_id", "text") < upto, F.lit(True)))
    counted = rows.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages, groups = sorted(sizes), []
    if len(languages) > GROUP:
        summed = common.written(summed, "language-counts")
    for i in range(0, len(languages), GROUP):
        own = languages[i : i + GROUP]
        found = (summed.filter(F.col("lang").isin(own)) if len(languages) > GROUP else summed).toPandas()  # at most GROUP x BUCKETS rows
        matrix = np.zeros((BUCKETS, len(own)))
        matrix[found["bucket"].to_numpy(), np.searchsorted(own, found["lang"])] = found["n"]
        matrix += SMOOTHING
        groups.append((own, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)))
    return Model(groups)


def predict(docs: DataFrame, model: Model, columns: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """These columns of docs, then the predicted language and its score, named by `names`."""
    at = f"c{columns.index('text')}" if "text" in columns else "text"
    held, back = common.aside(docs, columns, *([] if "text" in columns else [F.col("text").alias("text")]))
    held = held.withColumns({"found": F.lit(None).cast("string"), "best": F.lit(0.0), "odds": F.lit(0.0)})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    for languages, logs in model.groups:
        shared = docs.sparkSession.sparkContext.broadcast((languages, logs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, matrix = shared.value
            for batch in batches:
                for block in common.blocks(iter([batch]), at, 2 << 20):
                    block = block.combine_chunks()
                    texts = common.texts(block.column(at))
                    rows = np.flatnonzero(np.fromiter(map(_has_letter, texts), bool, len(texts)))
                    found, best, odds = (block.column(c).to_pylist() for c in ("found", "best", "odds"))
                    mean = mean_scores([texts[i] for i in rows.tolist()], matrix)
                    for i, k, scores in zip(rows.tolist(), mean.argmax(axis=1).tolist(), mean, strict=True):
                        top = float(scores[k])
                        # a document's n-grams overlap, so it counts as 20 draws of its mean
                        if found[i] is None:
                            found[i], best[i], odds[i] = own[k], top, float(np.exp(20 * (scores - top)).sum())
                        elif top > best[i]:
                            found[i], best[i], odds[i] = own[k], top, odds[i] * np.exp(20 * (best[i] - top)) + float(np.exp(20 * (scores - top)).sum())
                        else:
                            odds[i] += float(np.exp(20 * (scores - best[i])).sum())
                    out = {c: block.column(c) for c in block.column_names} | {"found": pa.array(found, pa.string()), "best": pa.array(best, pa.float64()), "odds": pa.array(odds, pa.float64())}
                    yield from pa.table(out).to_batches()

        held = held.mapInArrow(run, fields)
    return held.select(*back, F.coalesce("found", F.lit(UNDETERMINED)).alias(names[0]), F.when(F.col("found").isNotNull(), 1 / F.col("odds")).otherwise(F.lit(0.0)).alias(names[1]))


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows whose language is determined with at least this score, all columns as they were."""
    held, back = common.aside(docs, docs.columns)
    at = docs.columns.index("text")
    held, back[at] = held.withColumnRenamed(f"c{at}", "text"), F.col("text")
    told = predict(held, fit(docs), held.columns, ("found", "sure"))
    return told.filter((F.col("found") != UNDETERMINED) & (F.col("sure") >= least)).select(*back)


def crc_part(column: str, parts: int) -> Column:
    """crc32 of a column's text, modulo parts; null stands for the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))
