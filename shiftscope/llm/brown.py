"""Brown class-based n-grams: exchange clustering, class transitions and word emissions.

A text's probability is the product over its tokens of p(class | class before) * p(word | class). Tokens are words
`[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end for each text, which is also what stands before its
first word. Words are named by 64-bit hashes.

1. Blocks. Each task names the words of a block of documents by block-local numbers and writes the block's
   dictionary and the numbers, so later steps move a word once a block and not once an occurrence.
2. Counts. Every training word's count, summed over blocks; the CONTEXTS commonest become context symbols.
3. Contexts. For every training word, how often each context symbol stands before and after it, all rarer
   neighbours counted as one symbol. Rows of one word merge in a sorted stream.
4. Exchange clustering, for `rounds` rounds: each word moves to the class that raises the likelihood of class
   bigrams most, its own counts taken out of its present class. What a round must know of the others is a
   matrix of classes by context classes and the context symbols' classes, bounded and broadcast; all words of
   a round move at once. The first classes are the commonest words, one each, and one for the rest.
5. Scoring. Classes and counts go back to the blocks that hold a word; each text becomes a string of classes
   with the sum of its emissions; class bigrams of training texts are summed (bounded), smoothed, and
   applied to all.

Smoothing. Words seen once in training stand for words never seen: an unknown word is a class of its own, with
transitions to and from it as words seen once have them; its emission is 1. Transitions are Witten-Bell-like
mixtures with the classes' own shares, so every row sums to one.

Null counts as empty: one end token. Rows with null doc_id are scored as others are, repeated rows each on their
own. Where nothing is trained every token is unknown. An empty table gives an empty result. Columns besides
doc_id, text and the flag are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CLASSES, CONTEXTS, ROUNDS = 64, 4095, 3
#: Text bytes whose words share a dictionary, whose contexts are counted together, and of the pieces that move.
BLOCK, COUNTED, PIECE = 24 << 20, 10 << 20, 2 << 20
#: Weight of the classes' own shares in a transition.
MIXED = 8.0
#: Rows into which a context symbol's counts are spread before they meet.
SALTS = 16
#: Counts up to which what a word's entry adds is looked up.
FEW = 32
#: More than a block has different words.
_PLACES = 1 << 27
#: Flag of a word seen once, and the class of one never seen; classes are below ONCE.
ONCE, UNKNOWN = 128, 127

_END = b" "  # no word has a space
END_NAME = xxhash.xxh64_intdigest(_END) - (1 << 64 if xxhash.xxh64_intdigest(_END) >> 63 else 0)
_ZSTD = pa.Codec("zstd")


def _packed(ids: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(ids).to_bytes(8, "little") + _ZSTD.compress(planes).to_pybytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = _ZSTD.decompress(blob[8:], 4 * n).to_pybytes()
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()


class _Numbers(dict):
    """A word's number, by first appearance; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def names(self) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter(map(digest, self), np.uint64, len(self)).view(np.int64)


def _numbered(contents: list[bytes], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' numbers, ends included, and where each text's tokens end."""
    out, ends, n = [], [], 0
    for content in contents:
        words = content.lower().split()  # of bytes: A-Z, and at \x20 and \x09-\x0D
        out.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
        out.append(np.zeros(1, np.uint32))
        n += len(words) + 1
        ends.append(n)
    return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array(ends, np.int64)


def _piece(doc_id: pa.ChunkedArray, held: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """Texts as numbers in one value: doc_ids and whether they are null, flags, ends, then the tokens."""
    known = pc.is_valid(doc_id).to_numpy().astype(np.uint8)
    numbers = pc.fill_null(doc_id, 0).to_numpy().astype("<i8")
    return len(ends).to_bytes(8, "little") + numbers.tobytes() + known.tobytes() + held.astype(np.uint8).tobytes() + ends.astype("<i8").tobytes() + _packed(ids)


def _opened(piece: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(piece[:8], "little")
    numbers, known, held = np.frombuffer(piece, "<i8", n, 8), np.frombuffer(piece, np.uint8, n, 8 + 8 * n), np.frombuffer(piece, np.uint8, n, 8 + 9 * n)
    ends = np.frombuffer(piece[8 + 10 * n : 8 + 18 * n], "<i8")
    return pa.array(numbers, pa.int64(), mask=known == 0), held.astype(bool), ends, _unpacked(piece[8 + 18 * n :])


_BLOCKS = "block long, names array<long>, counts array<int>, piece binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("names", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("piece", pa.binary())])


def _rows(docs: DataFrame, held: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held"))


def blocks(docs: DataFrame, held: Column) -> DataFrame:
    """For each block a row with its dictionary (names and training counts), and rows with its texts as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 12
        for block in common.blocks(batches, most=BLOCK):
            numbers = _Numbers({_END: 0})
            counts = np.zeros(0, np.int64)
            for piece in common.blocks(iter(block.to_batches()), most=PIECE):
                ids, ends = _numbered(common.encoded(piece.column("text")), numbers)
                flags = piece.column("held").to_numpy()
                trained = ids[np.repeat(~flags, np.diff(ends, prepend=0))]
                own = np.bincount(trained, minlength=len(numbers))
                own[: len(counts)] += counts
                counts = own
                row = {"block": [at], "names": [None], "counts": [None], "piece": [_piece(piece.column("doc_id"), flags, ends, ids)]}
                yield from common.emit(row, _BLOCK_SCHEMA)
            yield from common.emit({"block": [at], "names": [numbers.names()], "counts": [counts.astype(np.int32)], "piece": [None]}, _BLOCK_SCHEMA)
            at += 1

    return _rows(docs, held).mapInArrow(run, _BLOCKS)


def vocabulary(numbered: DataFrame) -> DataFrame:
    """name, n of every training token."""
    each = numbered.filter("names is not null").select(F.explode(F.arrays_zip("names", "counts")).alias("w"))
    return each.select(F.col("w.names").alias("name"), F.col("w.counts").cast("long").alias("n")).filter("n > 0").groupBy("name").agg(F.sum("n").alias("n"))


class Contexts:
    """Context symbols: the end, then the commonest words; the last number stands for all others."""

    def __init__(self, names: list[int]):
        self.names = [END_NAME, *(x for x in names if x != END_NAME)]
        self.order = np.argsort(np.array(self.names, np.int64))
        self.sorted = np.array(self.names, np.int64)[self.order]
        self.rare = len(self.names)
        self.width = self.rare + 1

    def numbers(self, names: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.sorted, names), len(self.sorted) - 1)
        return np.where(self.sorted[i] == names, self.order[i], self.rare)


_VECTORS = "name long, salt int, entries binary"
_VECTOR_SCHEMA = pa.schema([("name", pa.int64()), ("salt", pa.int32()), ("entries", pa.binary())])
_COUNT = (1 << 48) - 1


def _vector_batch(name: np.ndarray, salt: np.ndarray, entries: np.ndarray, sizes: np.ndarray) -> pa.Table:
    offsets = np.concatenate(([0], np.cumsum(sizes * 8))).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(name), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(entries))])
    return pa.Table.from_arrays([pa.array(name), pa.array(salt.astype(np.int32)), blobs], schema=_VECTOR_SCHEMA)


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a binary column and how many each row has."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint64), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8


def _context_counts(docs: DataFrame, held: Column, contexts: Contexts) -> DataFrame:
    """A row for each training word of a block: entries (place * width + symbol) << 48 | count; place 0 before, 1 after."""
    shared = docs.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        task = TaskContext.get().partitionId()
        for k, block in enumerate(common.blocks(batches, most=COUNTED)):
            block = block.filter(pc.invert(block.column("held")))
            numbers = _Numbers({_END: 0})
            ids, _ = _numbered(common.encoded(block.column("text")), numbers)
            if not len(ids):
                continue
            names = numbers.names()
            symbol = known.numbers(names)
            before = np.concatenate(([0], ids[:-1]))  # before a first word stands the end of another text
            after = np.concatenate((ids[1:], [0]))
            width = 2 * known.width
            keys = np.concatenate([ids.astype(np.int64) * width + symbol[before], ids.astype(np.int64) * width + known.width + symbol[after]])
            # what follows an end is the first word of a text, whichever comes next; both are the same pairs
            keys, n = np.unique(keys, return_counts=True)
            word, place = keys // width, keys % width
            entries = (place.astype(np.uint64) << np.uint64(48)) | n.astype(np.uint64)
            sizes = np.bincount(word, minlength=len(names))
            there = sizes > 0
            salt = np.where(symbol < known.rare, (task + k) % SALTS, 0)
            yield from _vector_batch(names[there], salt[there], entries, sizes[there]).to_batches(max_chunksize=20_000)

    return _rows(docs, held).mapInArrow(run, _VECTORS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the entries of equal (name, salt) in a sorted stream; of the last, what has come so far is held."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        name, salt = batch.column("name").to_numpy(), batch.column("salt").to_numpy()
        entries, sizes = _entries(batch.column("entries"))
        if held is not None:
            name, salt = np.concatenate((held[0], name)), np.concatenate((held[1], salt))
            entries, sizes = np.concatenate((held[2], entries)), np.concatenate((held[3], sizes))
        if not len(name):
            continue
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (salt[1:] != salt[:-1])
        group = np.repeat(np.cumsum(new) - 1, sizes)
        key = (group.astype(np.int64) << 16) | (entries >> np.uint64(48)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, count = key[order], (entries & np.uint64(_COUNT)).astype(np.int64)[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, count = key[first], np.add.reduceat(count, first)
        out = ((key & 0xFFFF).astype(np.uint64) << np.uint64(48)) | count.astype(np.uint64)
        heads = np.flatnonzero(new)
        sizes = np.bincount(key >> 16, minlength=len(heads))
        name, salt, cut = name[heads], salt[heads], len(out) - int(sizes[-1])
        held = name[-1:], salt[-1:], out[cut:], sizes[-1:]
        if len(name) > 1:
            yield from _vector_batch(name[:-1], salt[:-1], out[:cut], sizes[:-1]).to_batches()
    if held is not None:
        yield from _vector_batch(*held).to_batches()


def context_vectors(docs: DataFrame, held: Column, contexts: Contexts) -> DataFrame:
    """name, entries of every training word."""
    n = common.shuffle_partitions(docs.sparkSession)
    parts = _context_counts(docs, held, contexts).repartition(n, "name", "salt").sortWithinPartitions("name", "salt").mapInArrow(_merged, _VECTORS)
    parts = common.written(parts, "contexts", compression="zstd")
    ours = F.col("name").isin(contexts.names)
    # context symbols were spread over SALTS rows, so that none of them makes a task of its own
    common_words = parts.filter(ours).withColumn("salt", F.lit(0)).repartition(n, "name").sortWithinPartitions("name").mapInArrow(_merged, _VECTORS)
    out = parts.filter(~ours).unionByName(common_words).select("name", "entries")
    out.written_to = parts.written_to
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


class Round:
    """What a round of exchanges knows: context symbols' classes, class by context class counts, class sizes."""

    def __init__(self, of_symbol: np.ndarray, matrix: np.ndarray, sizes: np.ndarray):
        self.of_symbol, self.matrix, self.sizes = of_symbol, matrix.astype(np.float64), sizes.astype(np.float64)
        self.base = _xlogx(self.matrix)
        self.table: np.ndarray | None = None  # made where it is asked for, once a process and broadcast

    def gain(self, column: np.ndarray, x: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """(words, classes): what adding x to the columns of each class's row changes, over a word's entries; they begin at heads."""
        columns = self.matrix.shape[1]
        if self.table is None:
            added = np.arange(FEW + 1)[:, None, None]
            self.table = (_xlogx(self.matrix.T + added) - self.base.T).astype(np.float32).reshape(-1, len(self.sizes))
        at = np.where(x <= FEW, x, 0) * columns + column  # to add nothing changes nothing
        n = np.diff(heads, append=len(x))
        order = np.argsort(-n, kind="stable")  # the j-th entries of all words that have so many, at once
        first, left = heads[order], np.cumsum(np.bincount(n)[::-1])[::-1]
        out = np.zeros((len(heads), len(self.sizes)), np.float32)
        for j in range(len(left) - 1):
            m = left[j + 1]
            out[:m] += self.table.take(at[first[:m] + j], axis=0)
        out[order] = out.copy()
        big = np.flatnonzero(x > FEW)
        for i in range(0, len(big), 20_000):
            e = big[i : i + 20_000]
            more = (_xlogx(self.matrix[:, column[e]] + x[e]) - self.base[:, column[e]]).T.astype(np.float32)
            word, start = np.unique(np.searchsorted(heads, e, side="right") - 1, return_index=True)
            out[word] += np.add.reduceat(more, start, axis=0)
        return out


class Exchange:
    """Replays the rounds for a batch of words."""

    def __init__(self, contexts: Contexts, classes: int, seeds: dict[int, int], rounds: list[Round]):
        self.contexts, self.classes, self.seeds, self.rounds = contexts, classes, seeds, rounds
        names = np.array(sorted(seeds), np.int64)
        self.seed_names, self.seed_classes = names, np.array([seeds[x] for x in names.tolist()], np.int64)

    def first(self, name: np.ndarray) -> np.ndarray:
        """The end has the last class, the commonest words one each, all others the one before the last."""
        i = np.minimum(np.searchsorted(self.seed_names, name), len(self.seed_names) - 1)
        return np.where(self.seed_names[i] == name, self.seed_classes[i], self.classes - 2)

    def folded(self, of_symbol: np.ndarray, entries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Word, column (place and context class) and count, entries of one column added up."""
        place = (entries >> np.uint64(48)).astype(np.int64)
        count = (entries & np.uint64(_COUNT)).astype(np.int64)
        width, high = self.contexts.width, self.classes + 1
        column = place // width * high + of_symbol[place % width]
        key = np.repeat(np.arange(len(sizes)), sizes) * (2 * high) + column
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first] // (2 * high), key[first] % (2 * high), np.add.reduceat(count[order], first)

    def move(self, known: Round, own: np.ndarray, name: np.ndarray, entries: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        word, column, x = self.folded(known.of_symbol, entries, sizes)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        n = np.add.reduceat(np.where(column <= self.classes, x, 0), heads).astype(np.float64)
        size = known.sizes
        score = known.gain(column, x, heads).astype(np.float64)
        counts, which = np.unique(n, return_inverse=True)  # few against words
        score -= (2 * (_xlogx(size[None, :] + counts[:, None]) - _xlogx(size)[None, :]))[which]
        mine = known.matrix[own[word], column]
        out = np.add.reduceat(_xlogx(np.maximum(mine - x, 0)) - _xlogx(mine), heads)
        out -= 2 * (_xlogx(np.maximum(size[own] - n, 0)) - _xlogx(size[own]))
        score += out[:, None]
        rows = np.arange(len(own))
        score[rows, own] = 1e-6  # staying; moves must gain
        score[:, self.classes - 1] = -np.inf  # the end's alone
        best = score.argmax(axis=1)
        return np.where(name == END_NAME, self.classes - 1, best)

    def classes_of(self, name: np.ndarray, entries: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        own = self.first(name)
        for known in self.rounds:
            own = self.move(known, own, name, entries, sizes)
        return own


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("name").to_numpy(), *_entries(batch.column("entries"))


def word_classes(vectors: DataFrame, contexts: Contexts, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """name, n, class of every training word."""
    spark = vectors.sparkSession
    seeds = {x: k for k, x in enumerate(contexts.names[1 : classes - 1])} | {END_NAME: classes - 1}
    state = Exchange(contexts, classes, seeds, [])
    high = classes + 1
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(state)

        def known(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, total = shared.value, np.zeros(classes * 2 * contexts.width, np.int64)
            symbols: list[tuple[int, int]] = []
            for name, entries, sizes in _batches(batches):
                found = own.classes_of(name, entries, sizes)
                place, count = (entries >> np.uint64(48)).astype(np.int64), (entries & np.uint64(_COUNT)).astype(np.int64)
                key = np.repeat(found, sizes) * (2 * contexts.width) + place
                total += np.bincount(key, count, len(total)).astype(np.int64)
                number = own.contexts.numbers(name)
                at = number < own.contexts.rare
                symbols += zip(number[at].tolist(), found[at].tolist(), strict=True)
            at = np.flatnonzero(total)
            rows = {"kind": np.zeros(len(at), np.int32), "at": at, "n": total[at]}
            yield pa.RecordBatch.from_pydict(rows)
            if symbols:
                both = np.array(symbols, np.int64)
                yield pa.RecordBatch.from_pydict({"kind": np.ones(len(both), np.int32), "at": both[:, 0], "n": both[:, 1]})

        # at most classes * 2 * (CONTEXTS + 2) sums and CONTEXTS + 1 classes
        found = vectors.mapInArrow(known, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
        sums, symbols = found[found.kind == 0], found[found.kind == 1]
        of_symbol = np.full(contexts.width, classes, np.int64)  # all rarer ones are the last context class
        of_symbol[symbols["at"].to_numpy(np.int64)] = symbols["n"].to_numpy(np.int64)
        full = np.zeros(classes * 2 * contexts.width)
        full[sums["at"].to_numpy(np.int64)] = sums["n"]
        full = full.reshape(classes, 2, contexts.width)
        matrix = np.zeros((classes, 2, high))
        for s in range(contexts.width):
            matrix[:, :, of_symbol[s]] += full[:, :, s]
        state = Exchange(contexts, classes, seeds, [*state.rounds, Round(of_symbol, matrix.reshape(classes, 2 * high), full[:, 0].sum(axis=1))])
        shared.unpersist()
    last = spark.sparkContext.broadcast(state)
    schema = pa.schema([("name", pa.int64()), ("n", pa.int64()), ("class", pa.int32())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = last.value
        for name, entries, sizes in _batches(batches):
            place = (entries >> np.uint64(48)).astype(np.int64)
            count = np.where(place < own.contexts.width, (entries & np.uint64(_COUNT)).astype(np.int64), 0)
            n = np.add.reduceat(count, np.cumsum(sizes) - sizes)
            yield from common.emit({"name": name, "n": n, "class": own.classes_of(name, entries, sizes).astype(np.int32)}, schema)

    return vectors.mapInArrow(named, "name long, n long, class int")


def _classed(numbered: DataFrame, words: DataFrame, total: int, distinct: int, sizes: np.ndarray) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, emission and classes (a byte a token) of every row."""
    # a row's place in its block is one number, so that the sort compares no rows
    places = numbered.filter("names is not null").select("block", F.posexplode("names").alias("pos", "name"))
    told = places.join(words, "name").select((F.col("block") * _PLACES + F.col("pos")).alias("at"), (F.col("n") * 256 + F.col("class")).alias("value"), F.lit(None).cast("binary").alias("piece"))
    texts = numbered.filter("piece is not null").select((F.col("block") * _PLACES + _PLACES - 1).alias("at"), F.lit(None).cast("long").alias("value"), "piece")
    n = common.shuffle_partitions(numbered.sparkSession)
    # a block's dictionary comes before its texts
    stream = told.unionByName(texts).repartition(n, F.shiftright("at", 27)).sortWithinPartitions("at")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emission", pa.float64()), ("classes", pa.binary())])
    unseen = -np.log10(total + distinct + 1)

    def score(piece: bytes, value: np.ndarray) -> dict[str, list]:
        doc_id, held, ends, ids = _opened(piece)
        value = np.concatenate((value, np.full(max(0, int(ids.max()) + 1 - len(value)), -1, np.int64)))
        seen = value >= 0
        count, kind = np.maximum(value >> 8, 0), np.where(seen, value & 255, UNKNOWN)
        base = np.log10(count + 1.0) + unseen
        emitted = np.where(seen, np.log10(np.maximum(count, 1) / np.maximum(sizes[np.where(seen, kind, 0)], 1)), 0.0)
        mark = (kind + np.where(count == 1, ONCE, 0)).astype(np.uint8)
        starts = np.concatenate(([0], ends[:-1]))
        marks = mark[ids].tobytes()
        return {
            "doc_id": doc_id,
            "held_out": held,
            "n_tokens": ends - starts,
            "n_known": np.add.reduceat(seen[ids].astype(np.int64), starts),
            "base_score": np.add.reduceat(base[ids], starts),
            "emission": np.add.reduceat(emitted[ids], starts),
            "classes": [marks[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, value = None, [], None
        for batch in batches:
            block, pos = np.divmod(batch.column("at").to_numpy(), _PLACES)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if block[a] != at:
                    at, held, value = block[a], [], None
                words_end = a + int(np.searchsorted(pos[a:b], _PLACES - 1))
                if words_end > a:
                    held.append((pos[a:words_end], batch.column("value").slice(a, words_end - a).to_numpy(zero_copy_only=False).astype(np.int64)))
                if words_end == b:
                    continue
                if value is None:
                    value = np.full(max((int(p[-1]) for p, _ in held), default=-1) + 1, -1, np.int64)
                    for p, v in held:
                        value[p] = v
                    held = []
                for i in range(words_end, b):
                    yield from common.emit(score(batch.column("piece")[i].as_py(), value), schema, 2000)

    return stream.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary")


def _pairs(marks: bytes, last: int, classes: int, seen_once: bool) -> np.ndarray:
    """Numbers row * (classes + 1) + column of a text's transitions; the unknown word is class `classes`."""
    kind = np.frombuffer(marks, np.uint8)
    own = kind & (ONCE - 1)
    own = np.where(own == UNKNOWN, classes, own).astype(np.int64)
    before = np.concatenate(([last], own[:-1]))
    out = [before * (classes + 1) + own]
    if seen_once:
        # words seen once also stand for the unknown word, on either side and on both
        once = kind >= ONCE
        once_before = np.concatenate(([False], once[:-1]))
        out += [before[once] * (classes + 1) + classes, classes * (classes + 1) + own[once_before], np.full(int((once & once_before).sum()), (classes + 1) ** 2 - 1)]
    return np.concatenate(out)


def transitions(classed: DataFrame, classes: int = CLASSES) -> np.ndarray:
    """(classes + 1)^2 smoothed log10 probabilities, learned from rows not held out."""
    size = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for marks in batch.column("classes").to_pylist():
                total += np.bincount(_pairs(marks, classes - 1, classes, True), minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

    found = classed.filter("not held_out").select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most (classes + 1)^2 rows
    counts = np.zeros(size * size)
    counts[found["at"].to_numpy(np.int64)] = found["n"]
    counts = counts.reshape(size, size)
    share = counts.sum(axis=0) + 1
    mixed = counts + MIXED * share / share.sum()
    return np.log10(mixed / mixed.sum(axis=1, keepdims=True))


def score(docs: DataFrame, held: Column, classes: int = CLASSES, contexts: int = CONTEXTS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity of every row.

    Learns from the rows where `held` isn't true.
    """
    if not 4 <= classes < UNKNOWN:
        raise ValueError(f"classes must lie between 4 and {UNKNOWN - 1}")
    numbered = common.written(blocks(docs, held), "numbered", compression="zstd")
    vocab = common.written(vocabulary(numbered), "vocabulary", compression="zstd")
    facts = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    commonest = Contexts([r["name"] for r in vocab.orderBy(F.desc("n"), "name").limit(contexts).collect()])
    vectors = context_vectors(docs, held, commonest)
    words = common.written(word_classes(vectors, commonest, classes, rounds), "word-classes", compression="zstd")
    common.dropped(vectors)
    sizes = np.zeros(256)
    for r in words.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row a class
        sizes[r["class"]] = r["n"]
    classed = common.written(_classed(numbered, words, facts.total, facts.distinct, sizes), "classed", compression="zstd")
    common.dropped(numbered, vocab, words)
    shared = docs.sparkSession.sparkContext.broadcast(transitions(classed, classes).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = shared.value
            moved = np.array([logs[_pairs(x, classes - 1, classes, False)].sum() for x in batch.column("classes").to_pylist()], np.float64)
            total = moved + batch.column("emission").to_numpy()
            n = batch.column("n_tokens").to_numpy()
            out = {c: batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")}
            out |= {"train_tokens": np.full(len(n), facts.total, np.int64), "base_score": batch.column("base_score"), "score": total, "perplexity": 10 ** np.minimum(-total / n, 300)}
            yield pa.RecordBatch.from_pydict(out)

    return classed.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
