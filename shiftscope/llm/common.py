"""What the corpus operators share: the shared folder, bounded blocks of rows, document keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import dropped, shared_folder, written

__all__ = ["aside", "blocks", "document_key", "dropped", "emit", "encoded", "join_by_share", "shared_folder", "shuffle_partitions", "sizes", "texts", "written"]

#: Text bytes that a task takes up at once; a single longer document is a block of its own.
BLOCK_BYTES = 16 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that go with (doc_id, text); rows equal in both count as one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def aside(docs: DataFrame, columns: list[str], *more: Column) -> tuple[DataFrame, list[Column]]:
    """These columns of docs named by place, c0 and on, beside `more`, so that no name of theirs meets one of ours; and their way back."""
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], *more)
    return held, [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]


#: Keys that a join may broadcast, and rows of a key below which it never does.
HOT_KEYS, HOT_ROWS = 1000, 1000


def join_by_share(rows: DataFrame, facts: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined to facts (one row a key; column n: how many of the `total` rows have it), hot keys apart; n goes.

    Keys of over a thousandth of all rows, so at most HOT_KEYS, are broadcast, and their rows stay where they are; the
    others' rows meet their facts by a shuffle. Both tables are read twice, so they should be written ones.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = facts.filter(F.col("n") > least).drop("n")
    met = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.filter(F.col("n") <= least).drop("n"), on)
    return met.unionByName(rest)


def sizes(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def blocks(batches: Iterator[pa.RecordBatch], by: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Tables of whole rows with at most `most` bytes in column `by` (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        for i, n in enumerate(sizes(batch.column(by))):
            if size and size + n > most:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def encoded(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.ChunkedArray) -> list[str]:
    """Null counts as empty; bytes that aren't UTF-8 as U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in encoded(column)]


def emit(columns: dict, schema: pa.Schema, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded number of rows."""
    table = pa.table([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema)
    yield from table.to_batches(max_chunksize=rows)
