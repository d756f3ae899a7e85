"""Substring deduplication by recompression: equal passages get equal interior symbols.

A document is a row of words, each named by a 64-bit hash. Rounds rename: first maximal runs of one symbol, then
pairs of a symbol of the left class and one of the right class, the class being a bit of the symbol's name. A
name is a hash of what it stands for (level, parts, repeats), so it is the same in all documents and tasks
without a shared dictionary, and a passage that occurs twice is parsed alike inside, wherever it stands. Each
symbol carries the range of words that fixes it: its own, and as far as neighbours were looked at. If that
range lies in a window of `window` words, then an equal window elsewhere has the same symbol at the same place.

Every window is owned by the symbol with the least name of the highest level that it fixes, so equal windows have
equal owners at equal places, and a window whose owner occurs once is unique. The Spark round:

1. Each task parses its documents block by block and sends one row for each stretch of windows with one owner:
   the owner's name, joined with the words that all windows of the stretch have beside it, a check of all the words that
   the stretch spans, and where it stands. Names and checks come from two hashes of the words that are independent, so
   words that collide in one differ in the other. Names that occur more than once in a block are settled there, and the
   block sends one row for each such name, so a passage found everywhere sends as many rows as there are blocks.
2. Rows meet by name: unique ones end here, equal stretches are verified repeats, and stretches that share
   the name but differ somewhere are left to step 3.
3. For those stretches alone, the windows' own hashes meet, 128 bits of two independent kinds, again settled within
   blocks first.
4. Verified window starts go back to their documents, and the words they cover are removed.

Windows are judged on the input: all words of a repeated window go, in every document, the first as well. Words
are `[^\\x20\\x09-\\x0D]+`, unchanged; kept words are joined by one space; bytes that aren't UTF-8 are kept as U+FFFD.
Null counts as no words. Rows equal in doc_id and text are distinct occurrences of each other's passages. An empty
table gives an empty result. Columns besides doc_id and text (and n_chars, in `without_repeats`) are carried as they
are, whatever their names.

A name met everywhere has one row a block (BLOCK bytes of text), so at 100 TB some 16 million rows of 50 bytes, sorted by
one task with spill; no more of it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 35
#: Rounds of naming; the more, the longer the symbols and the fewer a window fixes.
LEVELS = 4
#: Text bytes that are parsed together.
BLOCK = 6 << 20
#: A row's state: unknown, a repeat that may have unlike ones elsewhere, evidence only, settled.
OPEN, OPEN_REPEAT, EVIDENCE, SETTLED = 0, 1, 2, 3

U = np.uint64


def mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    """A 64-bit hash of two 64-bit values, by place."""
    x = a * U(0x9E3779B97F4A7C15) + np.asarray(b, U) * U(0xC2B2AE3D27D4EB4F) + U(salt * 0x165667B19E3779F9 & (2**64 - 1))
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


class _Numbers(dict):
    """A word's number in its block, by first appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Words:
    """Names and checks of the words of several documents in a row, and each document's first place and end."""

    def __init__(self, contents: list[bytes]):
        numbers, ids, counts = _Numbers(), [], []
        for content in contents:
            words = content.split()  # of bytes: at \x20 and \x09-\x0D
            counts.append(len(words))
            ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        place = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        digest = xxhash.xxh3_64_intdigest
        self.names = np.fromiter(map(xxhash.xxh64_intdigest, numbers), U, len(numbers))[place]
        self.place, self.check = place, np.fromiter((digest(w, 97) for w in numbers), U, len(numbers))
        self.ends = np.cumsum(np.array(counts, np.int64))
        self.starts = self.ends - np.array(counts, np.int64)

    @property
    def checks(self) -> np.ndarray:
        """Made when asked for, as names and the parse of a block are most of a task's memory."""
        return self.check[self.place]

    @staticmethod
    def windows(words: np.ndarray, window: int, salt: int = 0) -> np.ndarray:
        """A hash of each `window` words in a row (names or checks), by doubling; across documents' borders too."""
        if len(words) < window:
            return np.zeros(0, U)
        span, h = 1, words
        while 2 * span <= window:
            h = mix(h[:-span], h[span:], salt + span)
            span *= 2
        if span < window:
            more = window - span
            h = mix(h[:-more], h[more:], salt + window)
        return h

    def window_starts(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window starts that ends in the same document, and that document."""
        count = np.maximum(0, self.ends - self.starts - window + 1)
        doc = np.repeat(np.arange(len(count)), count)
        first = np.repeat(self.starts - np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else self.starts, count)
        return np.arange(len(doc)) + first, doc


def parse(words: Words, levels: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols by level: names, first word that fixes each, and the end of the words that do.

    Documents' borders fix what they touch from outside: no window reaches over them.
    """
    n = len(words.names)
    name, low = words.names, np.arange(n, dtype=np.int32)
    high = low + 1
    start, end = low, high  # the words that a symbol stands for
    # first and last symbols of documents keep their places through all rounds: borders are marked by word
    border = np.zeros(n + 1, bool)
    border[words.starts[words.starts < n]] = True
    border[n] = True
    word = words.names
    yield name, low, high
    for level in range(1, levels + 1):
        m = len(name)
        if m < 2:
            return
        # runs: neighbours are equal and of one document
        at_border = border[start]
        at_border[0] = True
        same = np.zeros(m, bool)
        same[1:] = (name[1:] == name[:-1]) & ~at_border[1:]
        head = np.flatnonzero(~same)
        tail = np.append(head[1:], m) - 1
        count = tail - head + 1
        # a run ends where the neighbour differs; the neighbour's nearest word tells, or else all that fixes it
        before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, m - 1)
        new_low, new_high = low[head], high[tail]
        first, last = start[head], end[tail]
        told = word[np.maximum(first - 1, 0)] != word[end[head] - 1]
        inside = ~border[first]
        new_low = np.minimum(new_low, np.where(~inside | told, first - 1, np.minimum(low[before], first - 1)))
        told = word[np.minimum(last, n - 1)] != word[start[head]]
        inside = ~border[last]
        new_high = np.maximum(new_high, np.where(~inside | told, last + 1, np.maximum(high[after], last + 1)))
        name = np.where(count > 1, mix(name[head], count.astype(U), 2 * level), name[head])
        low, high, start, end = new_low, new_high, first, last
        # pairs: left class, then right class, in one document
        m = len(name)
        right = ((name * U(0x9E3779B97F4A7C15) + U(level)) >> U(40) & U(1)).astype(bool)
        joined = np.zeros(m, bool)  # with the next
        joined[:-1] = ~right[:-1] & right[1:] & ~border[start[1:]]
        second = np.zeros(m, bool)
        second[1:] = joined[:-1]
        alone_left, alone_right = ~joined & ~right, ~second & right
        new_low, new_high = low.copy(), high.copy()
        # a symbol that stayed alone has looked at the neighbour that might have joined it
        at = np.flatnonzero(alone_left)
        new_high[at] = np.maximum(high[at], np.where(border[end[at]], end[at] + 1, high[np.minimum(at + 1, m - 1)]))
        at = np.flatnonzero(alone_right)
        new_low[at] = np.minimum(low[at], np.where(border[start[at]], start[at] - 1, low[np.maximum(at - 1, 0)]))
        at = np.flatnonzero(joined)
        name = name.copy()
        name[at] = mix(name[at], name[at + 1], 2 * level + 1)
        new_high[at] = high[at + 1]
        end = end.copy()
        end[at] = end[at + 1]
        keep = ~second
        name, low, high, start, end = name[keep], new_low[keep], new_high[keep], start[keep], end[keep]
        yield mix(name, level, 97), low, high


def _least(name: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of symbols first..last (both never fall), the one of the least name, the leftmost of equals."""
    bits = U(len(name).bit_length())
    best = [(mix(name, 0, 23) >> bits << bits) | np.arange(len(name), dtype=U)]
    longest = int((last - first).max()) + 1
    while 2 << len(best) - 1 <= longest:
        step, x = 1 << len(best) - 1, best[-1]
        best.append(np.minimum(x[:-step], x[step:]))
    k = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), U)
    for level, x in enumerate(best):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(x[first[at]], x[last[at] - (1 << level) + 1])
    return (out & ((U(1) << bits) - U(1))).astype(np.int64)


def owners(words: Words, starts: np.ndarray, window: int, levels: int = LEVELS) -> tuple[np.ndarray, ...]:
    """Each window's owner: its name, which symbol of all levels' it is, and the range of words that fixes it."""
    parsed = list(parse(words, levels))
    owner, which = np.zeros(len(starts), U), np.zeros(len(starts), np.int64)
    lows, highs = starts.copy(), starts + window
    still, passed = np.arange(len(starts)), 0
    while parsed and len(still):
        name, low, high = parsed.pop()
        p = starts[still]
        # low and high never fall, so the symbols that a window fixes are a row
        first = np.cumsum(np.bincount(low + 1, minlength=len(words.names) + 2))[p]
        last = np.cumsum(np.bincount(np.minimum(high, len(words.names) + 1), minlength=len(words.names) + 2))[p + window] - 1
        there = first <= last
        at = still[there]
        if len(at):
            i = _least(name, first[there], last[there])
            owner[at], which[at], lows[at], highs[at] = name[i], passed + i, low[i], high[i]
        passed += len(name)
        still = still[~there]
    return owner, which, lows, highs


#: Base of the hash of a range of words, and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def stretches(words: Words, window: int = WINDOW, levels: int = LEVELS) -> tuple[np.ndarray, ...]:
    """Stretches of windows of one owner: their name, a hash of all words spanned, first window, windows, document.

    Of a window's words that its owner isn't fixed by, half at least are on one side. Windows with more on the
    left make one stretch and the others another; its name is the owner's with those words on that side that all
    its windows have, over half a window in all. A stretch has at most `window` windows, so its first and last
    one span all its words; and no two of them are equal, as equal windows have their owners at equal places.
    """
    starts, doc = words.window_starts(window)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, U), starts, starts, doc
    owner, which, low, high = owners(words, starts, window, levels)
    h = words.windows(words.checks, window)
    leans = low - starts > starts + window - high
    new = np.ones(len(starts), bool)
    new[1:] = (which[1:] != which[:-1]) | (doc[1:] != doc[:-1]) | (leans[1:] != leans[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    spanned = mix(mix(h[starts[head]], h[starts[head + count - 1]], 11), count.astype(U), 13)
    owner, low, high, leans = owner[head], low[head], high[head], leans[head]
    beside = (window - (high - low) + 1) // 2
    a, b = np.where(leans, low - beside, low), np.where(leans, high, high + beside)
    n = len(words.names)
    summed = np.concatenate((np.zeros(1, U), np.cumsum(words.names * _powers(_BASE, n))))
    common_words = (summed[b] - summed[a]) * _powers(_INVERSE, n)[a]
    name = mix(mix(owner, common_words, 29), leans.astype(U), 31)
    return name, spanned, starts[head], count, doc[head]


def _grouped(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, ...]:
    """By row: different checks of its key, rows equal in both, whether it is the first of its key, of both."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new_both = new_key.copy()
    new_both[1:] |= c[1:] != c[:-1]
    group, both = np.cumsum(new_key) - 1, np.cumsum(new_both) - 1
    checks, rows = np.bincount(group[new_both]), np.bincount(both)
    out = np.empty(len(k), np.int64), np.empty(len(k), np.int64), np.empty(len(k), bool), np.empty(len(k), bool)
    for to, what in zip(out, (checks[group], rows[both], new_key, new_both), strict=True):
        to[order] = what
    return out


_ROWS = "key long, check long, doc_id long, doc long, first int, n int, state int, repeat boolean, compare boolean"
_SCHEMA = pa.schema(
    [("key", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("doc", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("state", pa.int32()), ("repeat", pa.bool_()), ("compare", pa.bool_())]
)


class _Sender:
    """Rows of a block's stretches or windows."""

    def __init__(self, block: pa.Table, key, check, doc, first, n):
        self.ids, self.docs = block.column("doc_id").combine_chunks(), block.column("doc").to_numpy()
        self.key, self.check, self.doc, self.first, self.n = key, check, doc, first, n

    def rows(self, which: np.ndarray, state: int | np.ndarray, repeat, compare) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(which)
        if not len(at):
            return
        full = lambda x, kind: np.broadcast_to(np.asarray(x, kind), len(which))[at]
        key, check, doc, state = self.key[at], self.check[at], self.doc[at], full(state, np.int32)
        # what is settled needs no company: anywhere, evenly
        key = np.where(state == SETTLED, mix(check, self.first[at].astype(U) + self.docs[doc].view(U), 17), key)
        columns = [key.view(np.int64), check.view(np.int64), self.ids.take(pa.array(doc)), self.docs[doc], self.first[at].astype(np.int32), self.n[at].astype(np.int32), state, full(repeat, bool), full(compare, bool)]
        yield from pa.Table.from_arrays([pa.array(x) for x in columns], schema=_SCHEMA).to_batches(max_chunksize=50_000)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.document_key().alias("doc"), "text")


def _parsed(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, most=BLOCK):
            words = Words(common.encoded(block.column("text")))
            owner, spanned, first, n, doc = stretches(words, window)
            if not len(owner):
                continue
            send = _Sender(block, owner, spanned, doc, first - words.starts[doc], n)
            checks, rows, first_of_key, first_of_both = _grouped(owner, spanned)
            one = checks == 1
            # a name with one content here: one row asks the other blocks, its copies are repeats already
            yield from send.rows(one & first_of_key, np.where(rows > 1, OPEN_REPEAT, OPEN), rows > 1, False)
            yield from send.rows(one & ~first_of_key, SETTLED, True, False)
            # a name with several: one of each content goes to the comparison, one row tells the other blocks
            yield from send.rows(~one, SETTLED, rows > 1, first_of_both)
            yield from send.rows(~one & first_of_key, EVIDENCE, False, False)

    return _keyed(docs).mapInArrow(run, _ROWS)


def _by_name(rows: DataFrame) -> DataFrame:
    """Stretches that are repeats, and those whose windows are to be compared."""
    key = Window.partitionBy("key")
    by = key.orderBy("check")
    met = rows.withColumns({"a": F.lag("check").over(by), "b": F.lead("check").over(by), "a_state": F.lag("state").over(by)})
    met = met.withColumn("mixed", (F.min("check").over(key) != F.max("check").over(key)) | (F.max("state").over(key) == EVIDENCE))
    before, after = F.col("check").eqNullSafe(F.col("a")), F.col("check").eqNullSafe(F.col("b"))
    open_ = F.col("state").isin(OPEN, OPEN_REPEAT)
    repeat = F.when(open_, F.col("repeat") | before | after).otherwise(F.col("repeat"))
    # of equal stretches the first stands for all; evidence stands for none, its own stretch looks for company
    compare = F.when(open_, F.col("mixed") & ~(before & (F.col("a_state") != EVIDENCE))).otherwise(F.col("compare"))
    return met.filter(f"state != {EVIDENCE}").select("doc_id", "doc", "first", "n", repeat.alias("repeat"), compare.alias("compare")).filter("repeat or compare")


def _by_window(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("key").orderBy("check")
    met = rows.withColumns({"a": F.lag("check").over(by), "b": F.lead("check").over(by)})
    again = F.col("check").eqNullSafe(F.col("a")) | F.col("check").eqNullSafe(F.col("b"))
    return met.filter(F.col("repeat") | (again & (F.col("state") != SETTLED))).select("doc_id", "doc", "first", "n")


def _by_document(found: DataFrame) -> DataFrame:
    """Stretches of a document in one array; it is no longer than the document."""
    packed = F.struct("first", "n")
    return found.groupBy("doc", F.coalesce("doc_id", F.lit(-1)).alias("id")).agg(F.collect_list(packed).alias("stretches"))


def _with_stretches(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    keyed = _keyed(docs).withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    return keyed.join(_by_document(found), ["doc", "id"], how)


def _stretch_arrays(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and n of all stretches."""
    whole = pa.concat_arrays(column.chunks)
    n = pc.fill_null(pc.list_value_length(whole), 0).to_numpy().astype(np.int64)
    flat = whole.flatten()
    return np.repeat(np.arange(len(n)), n), flat.field("first").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)


def _compared(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Rows of the single windows of stretches that are to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, most=BLOCK):
            words = Words(common.encoded(block.column("text")))
            one, other = words.windows(words.names, window), words.windows(words.checks, window, 1000)
            row, first, n = _stretch_arrays(block.column("stretches"))
            if not len(n):
                continue
            at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            row = np.repeat(row, n)
            p = words.starts[row] + at
            key, check = one[p], other[p]
            send = _Sender(block, key, check, row, at, np.ones(len(p), np.int64))
            _, rows, _, first_of_both = _grouped(key, check)
            yield from send.rows(first_of_both, np.where(rows > 1, OPEN_REPEAT, OPEN), rows > 1, False)
            yield from send.rows(~first_of_both, SETTLED, True, False)

    return _with_stretches(docs, found, "inner").drop("id").mapInArrow(run, _ROWS)


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """A written table that the other reads, and doc_id, doc, first, n: n windows in a row, from word `first` of a document, each of which also starts elsewhere."""
    met = common.written(_by_name(_parsed(docs, window)), "stretches")
    single = _by_window(_compared(docs, met.filter("compare"), window))
    return met, met.filter("repeat").select("doc_id", "doc", "first", "n").unionByName(single)


def _covered(words: int, first: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    edge = np.bincount(first, minlength=words + 1) - np.bincount(first + n + window - 1, minlength=words + 1)
    return np.cumsum(edge)[:words] > 0


def _cut(block: pa.Table, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """How many words each text has, and those that no stretch covers."""
    row, first, n = _stretch_arrays(block.column("stretches"))
    bounds = np.searchsorted(row, np.arange(block.num_rows + 1)).tolist()
    for i, content in enumerate(common.encoded(block.column("text"))):
        words = content.split()
        a, b = bounds[i : i + 2]
        kept = words
        if b > a:
            covered = _covered(len(words), first[a:b], n[a:b], window)
            kept = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
        yield len(words), kept


def _joined(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "replace")


def _written_repeats(docs: DataFrame, window: int) -> DataFrame:
    met, found = repeats(docs, window)
    found = common.written(found, "repeats")
    common.dropped(met)
    return found


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, doc, kept (the kept words, joined by one space), n_words, n_removed of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, most=4 << 20):
            out: dict[str, list] = {"kept": [], "n_words": [], "n_removed": []}
            for words, kept in _cut(block, window):
                out["kept"].append(_joined(kept))
                out["n_words"].append(words)
                out["n_removed"].append(words - len(kept))
            yield from common.emit({"doc_id": block.column("doc_id"), "doc": block.column("doc"), **out}, schema, 2000)

    joined = _with_stretches(docs, _written_repeats(docs, window), "left").drop("id")
    return joined.mapInArrow(run, "doc_id long, doc long, kept string, n_words long, n_removed long")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of docs; texts that lose words keep the others joined by one space, n_chars follows.

    Rows meet their stretches once, whole, and are cut where they meet: what is kept meets no row again.
    """

    @F.arrow_udf("string")
    def cut(text: pa.Array, stretches: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([text, stretches], ["text", "stretches"])
        return pa.array((_joined(kept) for block in common.blocks([rows], most=4 << 20) for _, kept in _cut(block, window)), pa.string())

    found = _written_repeats(docs, window)
    held, back = common.aside(docs, docs.columns, common.document_key().alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"))
    joined = held.join(_by_document(found), ["doc", "id"], "left")
    loses = F.col("stretches").isNotNull()
    # texts that stay as they are aren't sent to be cut
    joined = joined.withColumn("kept", cut(F.when(loses, F.col(f"c{docs.columns.index('text')}")), "stretches"))
    for i, c in enumerate(docs.columns):
        new = {"text": F.col("kept"), "n_chars": F.length("kept")}.get(c)
        if new is not None:
            back[i] = F.when(loses, new.cast(docs.schema[c].dataType)).otherwise(F.col(f"c{i}")).alias(c)
    return joined.select(*back)
