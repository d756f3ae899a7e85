"""Conversation structure repair: the cheapest edits that give turns the form of an optional system turn and user/assistant pairs.

Edits of a turn: Keep (0), Rerole to user or assistant (3), Delete (4); blank and duplicate turns must go; a truncated
turn that stays costs 3 more; Insert an empty user or assistant turn anywhere (3). `repair` runs a forward Viterbi pass
over four grammar states (nothing yet, after system, after user, after assistant) that carries the least (cost, audit)
of each state; a turn's layer is closed by two rounds of inserts, as a third can only come back to a state at more cost.
Two audits of the same turns and cost never begin one another, so the least audit of a whole goes with the least of its parts.

A conversation may be of any size: turns are sorted over range partitions, which may part one; its runs of at most SEGMENT turns
become a table of (state before, state after) to (cost, audit), which compose; a fold joins the tables of a
conversation and holds the letters in which its states' audits differ, besides the audit that is its result. Edits go back to turns
by row, one to one. Only `text_hash` reads a conversation's text in one task, as its digest is of one stream: a turn
at a time, and nothing is held.

Turns stand by turn (nulls first), then by role, text (its first 64 characters, then its hash) and row; equal rows are each
a turn. Null roles and texts count as one space, a null conv_id is a conversation, null turns leave no gap. Text of any
length is moved, never gathered. An empty table gives empty results. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import common

#: Turns of a run, and rows of a batch that a fold gives.
SEGMENT, BATCH = 512, 2000
WHITE = " \t\n\x0b\f\r"

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of a role, by its initial.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}

#: The least (cost, audit) of each state that is reached.
Layer = dict[int, tuple[int, str]]


def _add(layer: Layer, state: int | None, cost: int, audit: str) -> None:
    if state is not None and (state not in layer or (cost, audit) < layer[state]):
        layer[state] = (cost, audit)


def _closed(layer: Layer) -> Layer:
    """With turns inserted at its end."""
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            for role in "ua":
                _add(layer, AFTER.get((state, role)), cost + INSERT, audit + "I")
    return layer


@lru_cache(maxsize=64)
def _edits(symbol: str) -> list[Layer]:
    """For each state before a turn, the layer behind it; a turn is its role's initial, upper case if it is truncated, '-' if it must go."""
    out = []
    for state in range(4):
        layer: Layer = {state: (DELETE, "D")}
        if symbol != "-":
            more = TRUNCATED if symbol.isupper() else 0
            _add(layer, AFTER.get((state, symbol.lower())), more, "K")
            for role in "ua":
                _add(layer, AFTER.get((state, role)), REROLE + more, "R")
        out.append(_closed(layer))
    return out


def _joined(layer: Layer, tables: list[Layer]) -> Layer:
    out: Layer = {}
    for state, (cost, audit) in layer.items():
        for end, (more, letters) in tables[state].items():
            _add(out, end, cost + more, audit + letters)
    return out


@lru_cache(maxsize=100_000)
def run_tables(symbols: str, first: bool) -> list[Layer]:
    """The layers behind a run of turns, for each state before it; of a conversation's first run, from its start with inserts alone."""
    starts = [_closed({START: (0, "")})] if first else [{state: (0, "")} for state in range(4)]
    for symbol in symbols:
        starts = [_joined(layer, _edits(symbol)) for layer in starts]
    return starts


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the faults that a checksum of conv_id:turn (null: a space) chooses."""
    number = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(number.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def numbered(turns: DataFrame) -> DataFrame:
    """A written table of turns with row_id and what tells equal ones of a conversation (same), blank ones and cut ones."""
    kept = F.rtrim("text", F.lit(WHITE))
    conv = F.col("conv_id").cast("string")
    same = F.concat_ws(":", conv.isNull().cast("string"), F.coalesce(conv, F.lit("")), F.length("role"), "role", "text")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "*", F.unhex(F.sha2(same, 256)).alias("same"), (kept == "").alias("blank"), (~F.substring(kept, -1, 1).isin(".", "!", "?")).alias("cut"))
    return common.written(rows, "turns", compression="zstd")


def first_turns(rows: DataFrame) -> DataFrame:
    """A written table of the first row of each conversation, role and text that isn't blank, and how many there are: a partial aggregate."""
    firsts = rows.filter("not blank").groupBy("same").agg(F.min(F.struct("turn", "row_id")).alias("first"), F.count("*").alias("n"))
    return common.written(firsts, "first-turns")


def with_faults(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Numbered rows with their first fault: blank, duplicate, truncated or null.

    A duplicate isn't the first of its conversation with its role and text; rows meet those firsts by hash, hot ones where they lie.
    """
    lit = rows.filter("not blank").select("row_id", "same")
    met = common.join_by_share(lit, firsts, ["same"], lit.count())
    later = met.filter(F.col("first.row_id") != F.col("row_id")).select("row_id", F.lit(True).alias("again"))
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    return rows.join(later, "row_id", "left").withColumn("fault", fault)


class Repaired(NamedTuple):
    """conversations: a row each, with gaps, counts of faults, cost and audit. edits: conv_id, place (among the turns that
    are left; null if deleted), row_id (null if inserted), edit, role (null if kept). turns: conv_id, place, role, text.
    tables: what they are read from, for common.dropped."""

    conversations: DataFrame
    edits: DataFrame
    turns: DataFrame
    tables: list[DataFrame]


def _symbol(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(initial)).otherwise(initial)


def _long(x: int) -> int:
    """As 64 bits hold it."""
    return (x + 2**63) % 2**64 - 2**63


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[dict]]]:
    """Turns of a conversation, at most SEGMENT at a time, and whether they are surely its first (another one was read before it)."""
    held: list[dict] = []
    first = False
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv_id"] != held[0]["conv_id"] or len(held) == SEGMENT):
                yield first, held
                first, held = row["conv_id"] != held[0]["conv_id"], []
            held.append(row)
    if held:
        yield first, held


_COUNTED = ["blank", "duplicate", "truncated"]


def _segment_schema(conv_id: StructField) -> StructType:
    ints = ["shard", "seq", "n", *_COUNTED, "illegal"]
    longs = ["first_turn", "last_turn", "different"]
    layers = [StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())), StructField("costs", ArrayType(LongType())), StructField("audits", ArrayType(StringType()))]
    return StructType([conv_id, *[StructField(c, IntegerType()) for c in ints], *[StructField(c, LongType()) for c in longs], StructField("ends_with", StringType()), StructField("begins_with", StringType()), StructField("first", StringType()), *layers, StructField("row_ids", ArrayType(LongType()))])


def _segments(turns: DataFrame) -> DataFrame:
    """Runs of turns in the order of their conversation: (shard, seq) rises along it."""
    spark = turns.sparkSession
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("same"), F.col("row_id")]
    light = turns.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), "same", "row_id", _symbol(F.col("role"), F.col("fault")).alias("symbol"), "fault", F.substring("role", 1, 1).alias("initial"))
    ordered = light.repartitionByRange(common.shuffle_partitions(spark), *by).sortWithinPartitions(*by).select("conv_id", "turn", "row_id", "symbol", "fault", "initial")
    schema = _segment_schema(StructField("conv_id", turns.schema["conv_id"].dataType))
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = TaskContext.get().partitionId(), []
        for seq, (first, rows) in enumerate(_runs(batches)):
            tables = run_tables("".join(r["symbol"] for r in rows), first)
            entries = [(a, b, *tables[a][b]) for a in range(len(tables)) for b in sorted(tables[a])]
            known = [r["turn"] for r in rows if r["turn"] is not None]
            initials = [r["initial"] for r in rows]
            row = {"conv_id": rows[0]["conv_id"], "shard": shard, "seq": seq, "n": len(rows), "first": "yes" if first else None, "begins_with": initials[0], "ends_with": initials[-1]}
            row |= {c: sum(r["fault"] == c for r in rows) for c in _COUNTED}
            row |= {"illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))}
            row |= {"first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "different": len(set(known))}
            row |= dict(zip(("starts", "ends", "costs", "audits"), map(list, zip(*entries, strict=True)), strict=True)) | {"row_ids": [r["row_id"] for r in rows]}
            out.append(row)
            if len(out) == BATCH:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return ordered.mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _fold(rows: Iterator[dict]) -> tuple[dict, list[dict]]:
    """A conversation's totals, and where each of its runs' letters begin: from its runs in order, a run at a time."""
    layer: Layer = {}
    done: list[str] = []  # letters that all states' audits share
    runs: list[tuple[int, int, int]] = []
    total = dict.fromkeys([*_COUNTED, "illegal", "different"], 0)
    lowest = last_turn = initial = None
    for r in rows:
        if runs:
            total["illegal"] += initial + r["begins_with"] not in LEGAL
        else:
            layer = {START: (0, "")} if r["first"] else _closed({START: (0, "")})
        for c in total:
            total[c] += r[c]
        if r["first_turn"] is not None:
            total["different"] -= r["first_turn"] == last_turn
            lowest = r["first_turn"] if lowest is None else lowest
            last_turn = r["last_turn"]
        initial = r["ends_with"]
        tables: list[Layer] = [{} for _ in range(4)]
        for a, b, cost, audit in zip(r["starts"], r["ends"], r["costs"], r["audits"], strict=True):
            tables[a][b] = (cost, audit)
        layer = _joined(layer, tables)
        shared = commonprefix([audit for _, audit in layer.values()])
        done.append(shared)
        layer = {state: (cost, audit[len(shared) :]) for state, (cost, audit) in layer.items()}
        runs.append((r["shard"], r["seq"], r["n"]))
    cost, rest = min(layer[state] for state in (START, ASSISTANT) if state in layer)
    audit = "".join([*done, rest])
    gaps = 0 if lowest is None else _long(last_turn - lowest + 1 - total.pop("different"))
    total.pop("different", None)
    left = len(audit) - audit.count("D")
    at = tokens = 0
    slices = []
    for shard, seq, n in runs:
        end = at
        while end < len(audit) and (n or audit[end] == "I"):
            n -= audit[end] != "I"
            end += 1
        slices.append({"shard": shard, "seq": seq, "letters": audit[at:end], "before": tokens, "system": left % 2})
        tokens += end - at - audit.count("D", at, end)
        at = end
    return {"gaps": gaps, **total, "cost": cost, "audit": audit}, slices


def _folded(segments: DataFrame) -> DataFrame:
    """A row a run with its letters; the last of a conversation has its totals too."""
    conv_id = segments.schema["conv_id"]
    totals = [StructField(c, LongType()) for c in ("gaps", *_COUNTED, "illegal", "cost")]
    schema = StructType([conv_id, StructField("shard", IntegerType()), StructField("seq", IntegerType()), StructField("letters", StringType()), StructField("before", LongType()), StructField("system", IntegerType()), *totals, StructField("audit", StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv, rows in groupby((row for batch in batches for row in batch.to_pylist()), lambda r: r["conv_id"]):
            total, slices = _fold(rows)
            slices[-1] |= total
            for some in slices:
                out.append({"conv_id": conv, **some})
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    # totals of runs alone: a thousandth of the turns of a conversation
    placed = segments.drop("row_ids").repartition(common.shuffle_partitions(segments.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "shard", "seq")
    return placed.mapInArrow(run, schema)


def _edited(folded: DataFrame, segments: DataFrame) -> DataFrame:
    """Each run's letters, turn by turn."""
    met = folded.select("shard", "seq", "conv_id", "letters", "before", "system").join(segments.select("shard", "seq", "row_ids"), ["shard", "seq"])
    schema = StructType([folded.schema["conv_id"], StructField("place", LongType()), StructField("row_id", LongType()), StructField("edit", StringType()), StructField("role", StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                place, ids = r["before"], iter(r["row_ids"])
                for letter in r["letters"]:
                    row = {"conv_id": r["conv_id"], "row_id": None if letter == "I" else next(ids), "edit": letter, "place": None, "role": None}
                    if letter != "D":
                        row["place"] = place
                        if letter != "K":
                            row["role"] = ("user", "assistant")[(place - r["system"]) % 2]
                        place += 1
                    out.append(row)
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return met.mapInArrow(run, schema)


def repair(turns: DataFrame) -> Repaired:
    """The cheapest edits of every conversation in turns (conv_id, turn, role, text); of several, the least audit."""
    rows = numbered(turns)
    firsts = first_turns(rows)
    segments = common.written(_segments(with_faults(rows, firsts)), "runs-of-turns")
    folded = common.written(_folded(segments), "folded-runs")
    edits = common.written(_edited(folded, segments), "edits")
    conversations = folded.filter(F.col("audit").isNotNull()).select("conv_id", "gaps", *_COUNTED, "illegal", "cost", "audit")
    own = rows.select("row_id", F.col("role").alias("own_role"), "text")
    kept = edits.filter("edit in ('K', 'R')").join(own, "row_id").select("conv_id", "place", F.coalesce("role", "own_role").alias("role"), "text")
    inserted = edits.filter("edit = 'I'").select("conv_id", "place", "role", F.lit("").alias("text"))
    return Repaired(conversations, edits, kept.unionByName(inserted), [rows, firsts, segments, folded, edits])


def text_hash(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 (lowercase hex) of its turns as role:text, a line each; a stream in order, a turn at a time."""
    schema = StructType([turns.schema["conv_id"], StructField("sha256", StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((conv, line) for batch in batches for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True))
        out = []
        for conv, lines in groupby(rows, lambda r: r[0]):
            digest, between = hashlib.sha256(), b""
            for _, line in lines:
                digest.update(between)
                digest.update(line)
                between = b"\n"
            out.append({"conv_id": conv, "sha256": digest.hexdigest()})
            if len(out) == BATCH:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    lines = turns.select("conv_id", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    placed = lines.repartition(common.shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place")
    return placed.select("conv_id", "line").mapInArrow(run, schema)
