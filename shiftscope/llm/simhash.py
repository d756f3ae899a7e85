"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees over shards.

A fingerprint has a bit where over half of the document's shingle hashes have it. Different fingerprints are
few against documents, so copies meet as one row before any search.

Sharding. Fingerprints that differ in at most `radius` bits agree in at least two of the radius + 2 fields into
which the 64 bits are cut, so a shard for each pair of fields and its value loses no link. A shard of over `TREE`
fingerprints is sharded again by pairs of fields of the bits left, in which its members may differ as much. Each shard
is a BK-tree: children are keyed by their integer Hamming distance to the parent, and a search follows only edges
within the radius of its own distance. Shard trees are made where the shuffle puts the shard. They are not
broadcast: a tree is asked by its own shard's members alone, which the shuffle has put beside it, and all trees
together grow with the corpus. What is over `TREE` even then is cut into blocks by hash; each two of its blocks meet
as a tree of one and queries of the other, so no task holds more than two blocks however many fingerprints agree.

A search gives a union of what lies together, and only the tree's spanning links leave the task: one a
fingerprint at most. Components are found by rounds in which every fingerprint takes the smallest label of its
neighbours and of its label's label, on tables checkpointed to the shared folder.

A document without words has fingerprint zero and links like any other; null counts as empty. component_id is
the smallest non-null doc_id reachable; null only if all are null. Repeated rows are linked as equal
fingerprints are. An empty table gives an empty result. Columns besides doc_id and text are not read, and `one_of_each`
carries them as they are, whatever their names. Bytes that aren't UTF-8 are hashed as they are.

Joins of all rows by fingerprint or by component have their hot keys broadcast (common.join_by_share); the joins of the
rounds are of different fingerprints that have a neighbour, and leave hot labels to Spark's splitting of skewed joins.

`similar_documents` and `one_of_each` link by similarity: at 0.8 of five-word shingles two whole texts' fingerprints
differ in a dozen bits, beyond what shards of fields can find. So a text has, beside the SimHash of all its shingles,
SimHashes of bounded samples, each of five min-wise shingles; texts whose samples agree have equal ones, which bounds the
chance of a miss for every pair alike. Fingerprints of a kind (all, or which sample) are linked in BK-trees within the
radius; a shard for each field and its value loses no link, as of radius + 1 fields one agrees, and the rare shard of
over `TREE` goes the way above. Texts of linked fingerprints are candidates. Every pair of candidates is tested on the
shingles, and only pairs that pass unite.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS, WORDS, SEED = 2, 3, 42
#: Fingerprints in a tree.
TREE = 4096


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """Of a text's UTF-8; A-Z count as a-z."""
    parts = data.lower().split()  # of bytes: at \x20 and \x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = len(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, n) + 1
    ends = lengths.cumsum() - 1
    starts = (ends - lengths + 1)[: n - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(64, np.int64), n - words + 1
    for g in range(0, total, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[g : g + (1 << 15)], ends[words - 1 + g : words - 1 + g + (1 << 15)].tolist(), strict=True)], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key (see common.document_key) and fp, a fingerprint's 64 bits as a long."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, most=4 << 20):
            fp = np.array([fingerprint(x, words) for x in common.encoded(block.column("text"))], np.uint64)
            yield from common.emit({"doc_id": block.column("doc_id"), "key": block.column("key"), "fp": fp.view(np.int64)}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.document_key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


class BKTree:
    """Children keyed by Hamming distance to the parent."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (value ^ node[0]).bit_count():
            below = node[1].get(d)
            if below is None:
                node[1][d] = (value, {})
                return
            node = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            other, edges = stack.pop()
            d = (value ^ other).bit_count()
            if d <= radius:
                yield other
            if edges:
                for k in range(max(1, d - radius), d + radius + 1):
                    if k in edges:
                        stack.append(edges[k])


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning(stored: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what queries find in a tree of `stored`: (member, its group's smallest)."""
    tree, parent = BKTree(), {}
    if stored is queries:
        # each is a query against those before it
        for x in queries:
            parent[x] = x
            for y in tree.within(x, radius):
                a, b = _find(parent, x), _find(parent, y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            tree.add(x)
    else:
        for x in stored:
            tree.add(x)
        for x in queries:
            for y in tree.within(x, radius):
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                a, b = _find(parent, x), _find(parent, y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(x, top) for x in parent if (top := _find(parent, x)) != x]


def _pairs_of_fields(places: list[int], radius: int) -> list[int]:
    """A mask for each pair of the radius + 2 fields into which these bits are cut."""
    cuts = [round(i * len(places) / (radius + 2)) for i in range(radius + 3)]
    fields = [sum(1 << p for p in places[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [x | y for x, y in combinations(fields, 2)]


def _signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def _sized(spread: DataFrame) -> DataFrame:
    sizes = spread.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return spread.join(sizes, "shard")


def shards(distinct: DataFrame, radius: int = RADIUS, most: int = TREE) -> DataFrame:
    """fp with the shards it lies in, shards of one fingerprint left out: shard, n (its size)."""
    masks = _pairs_of_fields(list(range(64)), radius)
    key = lambda k, mask: F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bits"))
    placed = _sized(distinct.select("fp", F.explode(F.array(*[key(k, mask) for k, mask in enumerate(masks)])).alias("shard")))
    placed = common.written(placed, "shards")
    finer = F.array().cast("array<struct<k:int,bits:bigint>>")
    for k, mask in enumerate(masks):
        below = _pairs_of_fields([p for p in range(64) if not mask >> p & 1], radius)
        finer = F.when(F.col("shard.k") == k, F.array(*[key(len(masks) * (k + 1) + j, mask | more) for j, more in enumerate(below)])).otherwise(finer)
    again = _sized(placed.filter(F.col("n") > most).select("fp", F.explode(finer).alias("shard")))
    return placed.filter(F.col("n") <= most).unionByName(again)


def links(distinct: DataFrame, radius: int = RADIUS, most: int = TREE) -> DataFrame:
    """a, b: links that join all fingerprints that differ in at most `radius` bits, a not b."""
    placed = shards(distinct, radius, most)
    # a shard over `most` is cut into blocks; a fingerprint goes to each pair that its block is in
    count = F.ceil(F.col("n") / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("fp"), count).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), count - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    dealt = placed.select("fp", "shard", own.alias("own"), F.explode(pairs).alias("pair"))
    # trees of many shards to a task: one Arrow stream sorted by tree, not a Python call for each
    n = max(common.shuffle_partitions(distinct.sparkSession), 1)
    dealt = dealt.select("fp", F.col("shard.k").alias("k"), F.col("shard.bits").alias("bits"), F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own")
    ordered = dealt.repartition(n, "k", "bits", "i", "j").sortWithinPartitions("k", "bits", "i", "j")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def done() -> list[tuple[int, int]]:
            i, j = at[2:]
            return spanning(held[0], held[0], radius) if i == j else spanning(held[0], held[1], radius)

        out: list[tuple[int, int]] = []
        for batch in batches:
            value = batch.column("fp").to_numpy().view(np.uint64).tolist()
            for fp, tree, own in zip(value, zip(*(batch.column(c).to_pylist() for c in ("k", "bits", "i", "j")), strict=True), batch.column("own").to_pylist(), strict=True):
                if tree != at:
                    if at is not None:
                        out += done()
                    at, held = tree, ([], [])
                held[0 if own == tree[2] else 1].append(fp)
            if len(out) > 10_000:
                yield _link_batch(out, schema)
                out = []
        if at is not None:
            out += done()
        if out:
            yield _link_batch(out, schema)

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _link_batch(pairs: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable, as a signed long) for the nodes of edges a, b.

    Each round hooks every node to the smallest label among its neighbours' and jumps to its label's label.
    """
    both = common.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    state = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    state = common.written(state, "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = state.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        # the label's own neighbours may know a smaller one
        lows = hooked.groupBy(F.col("label").alias("top")).agg(F.min("low").alias("of_top"))
        hooked = hooked.join(lows, F.col("label") == F.col("top")).select("node", F.col("label").alias("was"), F.least("low", "of_top").alias("low"))
        jump = state.select(F.col("node").alias("low"), F.col("label").alias("beyond"))
        following = hooked.join(jump, "low").select("node", "was", F.least("low", "beyond").alias("label"))
        following = common.written(following, "labels")
        common.dropped(state)
        state = following
        if following.filter("label < was").isEmpty():
            common.dropped(both)
            return state.select("node", "label")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, most: int = TREE) -> DataFrame:
    """doc_id, key, fp and component_id of every row."""
    marked = common.written(fingerprints(docs, words), "fingerprints")
    distinct = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    joined = common.written(links(distinct.select("fp"), radius, most), "tree-links")
    groups = components(joined)
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.col("n").alias("rows"), F.coalesce("label", "fp").alias("label"))
    named = common.written(named, "labelled-fingerprints")
    least = common.written(named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    by_fp = common.join_by_share(named, least, ["label"], named.count()).select("fp", F.col("rows").alias("n"), "component_id")
    found = common.join_by_share(marked, common.written(by_fp, "of-fingerprints"), ["fp"], marked.count())
    return found.select("doc_id", "key", "fp", "component_id")


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x165667B19E3779F9 & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted hashes of a text's different shingles; fewer words make one, no word none."""
    parts = data.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(parts[i : i + words]), SEED) for i in range(max(1, len(parts) - words + 1))), np.uint64))


#: Samples of a document's shingles, and the min-wise shingles in each. Two texts share each minimum with their Jaccard
#: similarity as the chance, and have one SimHash where they share a sample's all, so at 0.8 a pair is missed with a
#: chance of (1 - 0.8 ** 5) ** 32 at most, 3 in a million.
SAMPLES, ROWS = 32, 5
_SALTS = _mixed(np.arange(1, SAMPLES * ROWS + 1, dtype=np.uint64), 3)
_FACTORS = _mixed(np.arange(SAMPLES * ROWS + 1, 2 * SAMPLES * ROWS + 1, dtype=np.uint64), 3) | np.uint64(1)


def _inverse(odd: np.ndarray) -> np.ndarray:
    """Modulo 2^64; each step doubles the bits that are right, three at first."""
    x = odd
    for _ in range(5):
        x = x * (np.uint64(2) - odd * x)
    return x


_BACK = _inverse(_FACTORS)


def sampled(own: np.ndarray) -> np.ndarray:
    """(SAMPLES, ROWS) of the shingles' hashes: for each of as many hash functions the one that it puts lowest."""
    low = np.full(SAMPLES * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 512):
        low = np.minimum(low, ((own[i : i + 512] ^ _SALTS[:, None]) * _FACTORS[:, None]).min(axis=1))
    return (low * _BACK ^ _SALTS).reshape(SAMPLES, ROWS)


def simhashes(own: np.ndarray) -> np.ndarray:
    """The SimHash of all of a text's shingles, then those of its samples; own: at least one shingle's hash."""
    bits = lambda h: np.unpackbits(h.view(np.uint8).reshape(*h.shape, 8), axis=-1, bitorder="little")
    votes = np.zeros((1 + SAMPLES, 64), np.int64)
    for i in range(0, len(own), 1 << 15):
        votes[0] += bits(own[i : i + (1 << 15)]).sum(axis=0, dtype=np.int64)
    votes[1:] = bits(sampled(own)).sum(axis=1)
    over = np.array([len(own)] + [ROWS] * SAMPLES)
    return np.packbits(2 * votes > over[:, None], axis=-1, bitorder="little").view(np.uint64).ravel()


def links_of_kinds(distinct: DataFrame, radius: int = RADIUS, most: int = TREE) -> DataFrame:
    """a, b: links that join all fingerprints of one kind that differ in at most `radius` bits, a not b. distinct: kind, fp."""
    cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    width = max(hi - lo for lo, hi in zip(cuts[:-1], cuts[1:], strict=True))
    fields = [
        F.shiftleft((F.col("kind") * (radius + 1) + k).cast("long"), width).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << hi - lo) - 1)))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
    ]
    placed = distinct.select("fp", F.explode(F.array(*fields)).alias("shard"))
    n = max(common.shuffle_partitions(distinct.sparkSession), 1)
    ordered = placed.repartition(n, "shard").sortWithinPartitions("shard")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        at, fp, crowded = none, none, None  # of the last shard, which may go on

        def crowd(of: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(of), pa.nulls(len(of), pa.int64())], schema=schema)

        for batch in chain(batches, [None]):
            if batch is not None:
                more_at, more_fp = batch.column("shard").to_numpy(), batch.column("fp").to_numpy()
                over = more_at == crowded if crowded is not None else np.zeros(len(more_at), bool)
                if over.any():
                    yield crowd(more_fp[over])
                    more_at, more_fp = more_at[~over], more_fp[~over]
                at, fp = np.concatenate((at, more_at)), np.concatenate((fp, more_fp))
            if not len(at):
                continue
            heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            ends = np.append(heads[1:], len(at))
            done = len(heads) if batch is None else len(heads) - 1
            several = np.flatnonzero(ends[:done] - heads[:done] > 1)
            out: list[tuple[int, int]] = []
            for i, j in zip(heads[several].tolist(), ends[several].tolist(), strict=True):
                if j - i > most:
                    yield crowd(fp[i:j])
                    continue
                members = fp[i:j].view(np.uint64).tolist()
                out += spanning(members, members, radius)
            if out:
                yield _link_batch(out, schema)
            left = len(at) if batch is None else heads[-1]
            at, fp = at[left:], fp[left:]
            if len(at) > most:
                yield crowd(fp)
                at, fp, crowded = none, none, at[0]

    found = common.written(ordered.mapInArrow(run, "a long, b long").distinct(), "kind-links")
    crowds = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    joined = found.filter("b is not null")
    return joined if crowds.isEmpty() else joined.unionByName(links(crowds, radius, most)).distinct()


def candidates(marked: DataFrame, radius: int = RADIUS, most: int = TREE) -> DataFrame:
    """key, n_shingles, sig: groups of documents with linked fingerprints of a kind. marked: node, n_shingles, fps (one of each kind)."""
    each = marked.select(F.col("node").alias("key"), "n_shingles", F.posexplode("fps").alias("kind", "fp"))
    distinct = common.written(each.groupBy("kind", "fp").agg(F.count(F.lit(1)).alias("n")), "kinds", compression="zstd")
    labels = components(links_of_kinds(distinct.select("kind", "fp"), radius, most))
    shared = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").filter("n > 1 or label is not null")
    shared = shared.select("kind", "fp", F.xxhash64("kind", F.coalesce("label", "fp")).alias("sig"))
    groups = common.written(each.join(shared, ["kind", "fp"]).select("key", "n_shingles", "sig"), "groups", compression="zstd")
    common.dropped(distinct)
    return groups


#: Documents of a group that meet pair by pair in the JVM at most; and documents and shingles of a block of a larger one.
FEW, BLOCK, BLOCK_SHINGLES = 8, 1024, 4 << 20


def verified_edges(sets: list[np.ndarray], similarity: float, comp: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges between sets that share `similarity` of both's elements, as many as join what such pairs join; comp says what is joined before.

    Each pair is tested on its whole sets unless its ends are joined by pairs that passed. With `side`, only pairs across it are.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    often = np.bincount(ids)
    starts, ends = often.cumsum() - often, sizes.cumsum()
    # sets with most in common first: an original joins its copies at once
    weight = np.add.reduceat(often[ids], ends - sizes)
    comp, out = comp.copy(), []
    for x in np.argsort(-weight, kind="stable").tolist():
        open_ = comp != comp[x]
        if side is not None:
            open_ &= side != side[x]
        if not open_.any():
            continue
        own = ids[ends[x] - sizes[x] : ends[x]]
        own = own[often[own] > 1]
        if not len(own):
            continue
        n = often[own]
        at = np.arange(n.sum()) + np.repeat(starts[own] - (n.cumsum() - n), n)
        both = np.bincount(owner[at], minlength=len(sets))
        passed = np.flatnonzero(open_ & (both > 0) & (both >= similarity * (sizes[x] + sizes - both)))
        labels, first = np.unique(comp[passed], return_index=True)
        if len(labels):
            out += [(x, y) for y in passed[first].tolist()]
            comp[np.isin(comp, labels)] = comp[x]
    return out


def verified_links(groups: DataFrame, sets: DataFrame, similarity: float, few: int = FEW, most: int = BLOCK) -> DataFrame:
    """a, b: links that join all documents that share a group and `similarity` of both's shingles at least.

    groups: key, n_shingles, sig; only groups of two or more documents. sets: key and shingles of their documents.
    Every pair of a group is tested before it is united. Pairs of small groups meet once, as rows. A larger group is
    tested where the shuffle puts it, in blocks of which each two meet, so no task holds more than two blocks.
    """
    sizes = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    placed = groups.join(sizes, "sig")
    small = placed.filter(F.col("n") <= few).groupBy("sig").agg(F.array_sort(F.collect_list("key")).alias("keys")).select("keys").distinct()
    each = small.select("keys", F.posexplode("keys").alias("at", "a"))
    pairs = each.select("a", F.explode(F.slice("keys", F.col("at") + 2, few)).alias("b")).distinct()
    met = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    # row by row in the JVM: a batch of pairs would hold thousands of sets
    both = F.size(F.array_intersect("x", "y"))
    of_few = met.filter(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).select("a", "b")

    count = F.ceil(F.greatest(F.col("n") / F.lit(most), F.col("total") / F.lit(BLOCK_SHINGLES))).cast("int")
    own = F.pmod(F.xxhash64("key"), count).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    dealt = placed.filter(F.col("n") > few).select("key", "sig", own.alias("own"), F.explode(blocks).alias("pair"))
    dealt = dealt.select("key", "sig", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), (F.col("own") == F.col("pair.i")).alias("first")).join(sets, "key")
    n = max(common.shuffle_partitions(groups.sparkSession), 1)
    ordered = dealt.repartition(n, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}  # what has passed in this task
        at, keys, sides, held = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            for k in keys:
                parent.setdefault(k, k)
            comp = np.unique([_find(parent, k) for k in keys], return_inverse=True)[1]
            found = verified_edges(held, similarity, comp, np.array(sides) if at[1] != at[2] else None)
            for x, y in found:
                a, b = _find(parent, keys[x]), _find(parent, keys[y])
                parent[max(a, b)] = min(a, b)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in found], pa.int64()), pa.array([keys[y] for _, y in found], pa.int64())], schema=schema)

        for batch in batches:
            lists = batch.column("shingles")
            values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for r, tree in enumerate(zip(*(batch.column(c).to_pylist() for c in ("sig", "i", "j")), strict=True)):
                if tree != at:
                    if at is not None:
                        yield from done()
                    at, keys, sides, held = tree, [], [], []
                keys.append(batch.column("key")[r].as_py())
                sides.append(batch.column("first")[r].as_py())
                held.append(values[ends[r] : ends[r + 1]].copy())
        if at is not None:
            yield from done()

    return of_few.unionByName(ordered.mapInArrow(run, "a long, b long")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, key, alt and component_id of every document linked to another: share `similarity` of both's shingles at least.

    Candidates are documents with SimHashes (of all their shingles, or of a sample) that BK-trees link; each pair of them is held to the exact share of shingles (Jaccard), and only pairs that
    pass unite. component_id is the smallest doc_id of a component, null if all are. Documents without words are not linked. Rows equal in doc_id and text are one document.
    """
    named_by = ["key", "alt"]  # 128 bits, and doc_id beside them: no two documents are taken for one
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("alt", pa.int64()), ("n_shingles", pa.int64()), ("fps", pa.list_(pa.int64()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, most=4 << 20):
            sets = [shingles(x, words) for x in common.encoded(block.column("text"))]
            fps = [simhashes(x).view(np.int64) for x in sets]
            yield from common.emit({c: block.column(c) for c in ("doc_id", "key", "alt")} | {"n_shingles": [len(x) for x in sets], "fps": fps}, schema)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_identity(), "text")
    marked = keyed.filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).mapInArrow(mark, "doc_id long, key long, alt long, n_shingles long, fps array<long>")
    # a number a document, kept by being written; all that follows knows documents by it
    marked = common.written(marked.dropDuplicates(["doc_id", *named_by]).withColumn("node", F.monotonically_increasing_id()), "signatures", compression="zstd")
    groups = candidates(marked)
    own = pa.schema([("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, most=1 << 20):
            sets = [shingles(x, words).view(np.int64) for x in common.encoded(block.column("text"))]
            yield from common.emit({"key": block.column("node"), "shingles": sets}, own, 500)

    involved = marked.select("node", F.col("doc_id").alias("of"), *named_by).join(groups.select(F.col("key").alias("node")).distinct(), "node", "left_semi")
    sets = keyed.join(involved, named_by).filter(F.col("doc_id").eqNullSafe(F.col("of"))).dropDuplicates([*named_by, "node"]).select("node", "text").mapInArrow(shingled, "key long, shingles array<long>")
    sets = common.written(sets, "shingles")
    verified = common.written(verified_links(groups, sets, similarity), "verified")
    common.dropped(groups, sets)
    labels = components(verified)
    named = common.written(labels.join(marked.select("node", "doc_id", *named_by), "node"), "labelled")
    common.dropped(marked, verified)
    least = common.written(named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    return common.join_by_share(named, least, ["label"], named.count()).select("doc_id", *named_by, "component_id")


def _identity(doc_id: str = "doc_id", text: str = "text") -> list:
    """128 bits that go with (doc_id, text): key and alt."""
    return [common.document_key(doc_id, text).alias("key"), F.xxhash64(F.lit("alt"), F.col(doc_id), F.col(text)).alias("alt")]


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose document has its component's smallest doc_id, all columns as they were.

    Components are those of similar_documents; documents linked to none stay, and so do all of a component without any doc_id.
    Rows equal in doc_id and text are one document.
    """
    found = similar_documents(docs, words, similarity)
    gone = found.filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("key", "alt", F.col("doc_id").alias("of"))
    held, back = common.aside(docs, docs.columns, *_identity(), F.col("doc_id").cast("long").alias("id"))
    same = (held["key"] == gone["key"]) & (held["alt"] == gone["alt"]) & held["id"].eqNullSafe(gone["of"])
    return held.join(gone, same, "left_anti").select(*back)


def hex_column(fp: str = "fp"):
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
