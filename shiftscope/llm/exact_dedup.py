"""Grace hash deduplication: partition by content hash, then compare whole contents in an open-addressing table.

1. Each map task puts its rows, block by block, through an open-addressing table, so copies that lie
   together leave as one record: the contents once, the members' ids beside them. However many copies
   there are, a group sends one record a block.
2. The records are written to the shared folder (the spill files of the classic algorithm, here a Parquet
   table, so that a lost executor costs nothing that was done) and dealt by bits of the content hash into
   buckets, many to a partition of about PARTITION bytes and sorted there. Buckets over `bucket_bytes` are dealt
   again by a hash of another seed, level by level, until each fits; a bucket of a single hash can't be dealt further
   and holds equal texts.
3. Each bucket goes through an open-addressing table of its own that compares complete contents. Hashes only choose
   slots; texts of equal hash that differ stay apart.
4. A text found in so many blocks that its records alone make over a bucket and a thousandth of all bytes is hot.
   At most common.HOT_KEYS are, so one content of each, REFERENCES bytes in all at most, is broadcast and the hot
   records are compared with it where they lie, wholly too; only what differs from it goes on to the buckets.
5. The class of a text is (content hash, ordinal among different texts of that hash). Group size and the
   row that stays are sums and maxima over classes, joined back to the records, the hot classes by broadcast, and
   never gathered in one task.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. The row with the largest
doc_id stays; a null doc_id is smaller than any. Rows that repeat both doc_id and text are members of the
same group, and all rows with the largest doc_id count as kept; `deduplicate` keeps one of them.
An empty table gives an empty result. `groups` reads doc_id and text alone; `deduplicate` carries all other columns
as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of different contents that a bucket's table may hold.
BUCKET_BYTES = 24 << 20
#: Levels of dealing anew; 16 bits each, so more would use up the hash.
MAX_LEVELS = 4
#: Bytes of records that a task takes up, bucket after bucket, and of hot contents that are broadcast.
PARTITION, REFERENCES = 128 << 20, 32 << 20


class ContentTable:
    """Open addressing with linear probing over complete contents; a slot has the hash and an ordinal."""

    def __init__(self, capacity: int = 1024):
        self.mask = capacity - 1
        self.slots = [-1] * capacity
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def ordinal(self, h: int, content: bytes) -> tuple[int, bool]:
        """The ordinal of this content, and whether it is new."""
        i = h & self.mask
        while (k := self.slots[i]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k, False
            i = (i + 1) & self.mask
        k = self.slots[i] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.contents) > self.mask:
            self._grow()
        return k, True

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for k, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = k


def _local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches, "__text"):
        block = block.combine_chunks()
        table = ContentTable()
        ids = block.column("__id").to_pylist()
        best: list[int] = []
        members: list[list] = []
        for row, content in enumerate(common.encoded(block.column("__text"))):
            content = content.lower()  # of bytes: A-Z only
            k, new = table.ordinal(xxhash.xxh64_intdigest(content), content)
            if new:
                best.append(row)
                members.append([ids[row]])
            else:
                members[k].append(ids[row])
                if ids[row] is not None and (ids[best[k]] is None or ids[row] > ids[best[k]]):
                    best[k] = row
        kept = block.take(pa.array(best, pa.int64()))
        out = kept.append_column("__hash", pa.array(np.array(table.hashes, np.uint64).view(np.int64)))
        out = out.append_column("__members", pa.array(members, pa.list_(pa.int64())))
        out = out.append_column("__bytes", pa.array(list(map(len, table.contents)), pa.int64()))
        yield from out.to_batches(max_chunksize=2000)


def local_groups(docs: DataFrame, payload: bool) -> DataFrame:
    """A record for each different text of a block: __text, __id (largest), __hash, __members, __bytes; payload: the row too."""
    rows = docs.select(
        *([F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("__row")] if payload else []),
        F.col("text").alias("__text"),
        F.col("doc_id").cast("long").alias("__id"),
    )
    if payload:  # the text travels once
        at = docs.columns.index("text")
        rows = rows.withColumn("__row", F.col("__row").dropFields(f"c{at}")) if len(docs.columns) > 1 else rows
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_local_groups, f"{fields}, __hash long, __members array<long>, __bytes long")


def _bucket(level: int, bits: int):
    """Level 0 takes bits of the content hash; deeper levels hash it anew."""
    h = F.col("__hash") if level == 0 else F.xxhash64(F.col("__hash"), F.lit(level))
    return F.pmod(h, F.lit(1 << bits)).cast("long")


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name each record's class; records come bucket by bucket, and only a bucket's different contents are held."""
    at = None
    for batch in batches:
        contents = common.encoded(batch.column("__text"))
        hashes = batch.column("__hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).tolist()
        which, sha = [], []
        for bucket, h, content in zip(batch.column("__bucket").to_pylist(), hashes, contents, strict=True):
            if bucket != at:
                at, table, count, rank, digests = bucket, ContentTable(), {}, [], []
            content = content.lower()
            k, new = table.ordinal(h, content)
            if new:
                rank.append(count.get(h, 0))
                count[h] = rank[-1] + 1
                digests.append(hashlib.sha256(content).hexdigest())
            which.append(rank[k])
            sha.append(digests[k])
        out = {c: batch.column(c) for c in batch.schema.names}
        out |= {"__ordinal": pa.array(which, pa.int32()), "__sha": pa.array(sha, pa.string())}
        yield pa.RecordBatch.from_pydict(out)


def _lowered(text: str):
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _hot_apart(pending: DataFrame, total: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Records for the buckets, and those that are equal to a hot content, with their class; None if nothing is hot."""
    often = pending.groupBy("__hash").agg(F.sum("__bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("__bytes").alias("size"))
    hot = often.filter((F.col("n") > 1) & (F.col("b") > max(bucket_bytes, total // common.HOT_KEYS)))
    upto = F.sum("size").over(Window.orderBy(F.desc("b"), "__hash"))  # of HOT_KEYS rows
    hot = hot.withColumn("upto", upto).filter(F.col("upto") <= REFERENCES).select("__hash")
    if hot.isEmpty():
        return pending, None
    like = pending.join(F.broadcast(hot), "__hash").groupBy("__hash").agg(F.first(_lowered("__text")).alias("__like"))
    like = F.broadcast(common.written(like, "grace-hot"))
    met = pending.join(like, "__hash", "left").withColumn("__same", F.coalesce(_lowered("__text") == F.col("__like"), F.lit(False))).drop("__like")
    same = met.filter("__same").withColumns({"__ordinal": F.lit(-1), "__sha": F.sha2(_lowered("__text").cast("binary"), 256)})
    return met.filter("not __same").drop("__same"), same.drop("__same")


def classes(docs: DataFrame, payload: bool = False, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """The records of local_groups() with their class: (__hash, __ordinal), and __sha of the contents; and the spill tables that they read."""
    spark = docs.sparkSession
    pending = common.written(local_groups(docs, payload), "grace-level-0")
    spilled = [pending]
    total = pending.agg(F.sum("__bytes").alias("b")).first().b or 0
    pending, found = _hot_apart(pending, int(total), bucket_bytes)
    for level in range(MAX_LEVELS):
        bits = max(0, (2 * int(total) // bucket_bytes).bit_length()) + 2
        dealt = pending.withColumn("__bucket", _bucket(level, bits))
        # contents of equal hash count once: the table holds one copy of each
        by_hash = dealt.groupBy("__bucket", "__hash").agg(F.max("__bytes").alias("b"))
        over = by_hash.groupBy("__bucket").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("b") > bucket_bytes) & (F.col("n") > 1)).select("__bucket")
        last = level == MAX_LEVELS - 1 or over.isEmpty()
        fits = dealt if last else dealt.join(over, "__bucket", "left_anti")
        n = max(common.shuffle_partitions(spark), int(total) // PARTITION)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fits.schema)
        part = fits.repartition(n, "__bucket").sortWithinPartitions("__bucket").mapInArrow(_classes, f"{fields}, __ordinal int, __sha string").drop("__bucket")
        found = part if found is None else found.unionByName(part)
        if last:
            break
        pending = common.written(dealt.join(over, "__bucket", "left_semi").drop("__bucket"), f"grace-level-{level + 1}")
        spilled.append(pending)
        total = pending.agg(F.sum("__bytes").alias("b")).first().b or 0
    return found.drop("__bytes"), spilled


def groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    found, spilled = classes(docs, bucket_bytes=bucket_bytes)
    named = common.written(found.drop("__text"), "grace-classes")
    common.dropped(*spilled)
    of_class = named.groupBy("__hash", "__ordinal").agg(F.max("__id").alias("keep_id"), F.sum(F.size("__members")).cast("long").alias("group_size"), F.count(F.lit(1)).alias("n"))
    of_class = common.written(of_class, "grace-groups")
    rows = common.join_by_share(named.select("__hash", "__ordinal", "__sha", "__members"), of_class, ["__hash", "__ordinal"], named.count())
    return rows.select(F.explode("__members").alias("doc_id"), "keep_id", "group_size", F.col("__sha").alias("text_sha256")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of docs that stay, one for each different text, with all their columns."""
    named, _ = classes(docs, payload=True, bucket_bytes=bucket_bytes)
    at = docs.columns.index("text")
    fields = [F.col("__text").alias("text") if i == at else F.col(f"__best.r.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    # of a class's records, one a block at most, the one with the largest id
    order = F.struct(F.col("__id").isNotNull().alias("known"), F.col("__id").alias("id"), F.xxhash64("__text").alias("t"), F.monotonically_increasing_id().alias("m"))
    named = named.withColumn("__order", order)
    best = named.groupBy("__hash", "__ordinal").agg(F.max_by(F.struct(F.col("__row").alias("r"), F.col("__text").alias("t")), F.col("__order")).alias("__best"))
    return best.select(*[F.col("__best.t").alias("text") if i == at else f for i, f in enumerate(fields)])
