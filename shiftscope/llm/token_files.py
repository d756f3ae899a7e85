"""Token-ID files: a concatenated id array with Elias-Fano encoded document boundaries.

`write_ids` puts documents in ascending doc_id order (range partitions, so no task sees more than its share),
encodes them and writes a table of segments in the shared folder; ids never travel. A segment is one binary value:

    8 bytes  magic, "EFIDS" with the format's version
    u32      bytes of an id (2 if the vocabulary fits, or 4)
    u64      documents
    u64      ids
    u32      low bits of a boundary
    ...      Elias-Fano: low bits, high bits, a u32 sample of each SAMPLED-th set high bit's place
    ...      ids, little-endian

Boundary i is the end of document i, counted from the segment's first id. Elias-Fano keeps n boundaries below u in
n * floor(log2(u / n)) low bits and at most 3 n high bits; `select` finds boundary i from the samples without
a table of 64-bit offsets. Beside it stand the segment's place (shard, seq), its start within the shard and its
documents' ids. `read_ids` reads segments back, each boundary by `select` from the samples: a shard's start is the
sum of those before it, a row a shard. `read_some` reads chosen documents alone: two selects each, and only their ids.

Null texts count as empty; each document has its end id at least. Null doc_ids come first; rows of one doc_id stand in
order of their texts' hash; equal rows are each a document; bytes that aren't UTF-8 count as U+FFFD. An empty table
gives no segment and an empty result. Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"EFIDS\x00\x00\x01"
SAMPLED = 64
#: Text bytes whose ids make a segment, one document at least.
SEGMENT = 2 << 20
#: Words whose ids a process keeps.
KEPT_WORDS = 1_200_000
_HEAD = struct.Struct("<8sIQQI")

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
#: Place of the k-th set bit of a byte.
_PLACE = np.array([np.pad(np.flatnonzero(row), (0, 8 - int(row.sum()))) for row in _BITS], np.int64)


class EliasFano:
    """A rising sequence of integers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        last = int(values[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        low = np.packbits((values[:, None] >> np.arange(low_bits)).astype(np.uint8) & 1, bitorder="little") if n and low_bits else np.zeros(0, np.uint8)
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLED].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, n: int, low_bits: int, data: memoryview) -> tuple[EliasFano, memoryview]:
        """Of the start of data, and what follows."""
        a, b, c = struct.unpack_from("<QQQ", data)
        at = struct.calcsize("<QQQ")
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data[at + a + b : at + a + b + 4 * c], "<u4")
        return cls(n, low_bits, low, high, samples), data[at + a + b + 4 * c :]

    def _low(self, i: int) -> int:
        at, k = i * self.low_bits, self.low_bits
        some = int.from_bytes(self.low[at // 8 : (at + k + 7) // 8].tobytes(), "little")
        return (some >> (at % 8)) & ((1 << k) - 1)

    def select(self, i: int) -> int:
        """Value i, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLED]), i % SAMPLED
        byte = place // 8
        left += int(_ONES[self.high[byte] & ((1 << place % 8) - 1)])  # set bits of that byte before the sample
        while left >= (ones := int(_ONES[self.high[byte]])):
            left -= ones
            byte += 1
        return ((8 * byte + int(_PLACE[self.high[byte], left]) - i) << self.low_bits) | self._low(i)

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """Values at many places, each from the sample before it, all of them a byte further at a time."""
        start = self.samples[i // SAMPLED].astype(np.int64)
        byte, left = start // 8, i % SAMPLED
        left = left + _ONES[self.high[byte] & ((1 << start % 8) - 1)]  # set bits of that byte before the sample
        open_ = np.flatnonzero(left >= _ONES[self.high[byte]])
        while len(open_):
            left[open_] -= _ONES[self.high[byte[open_]]]
            byte[open_] += 1
            open_ = open_[left[open_] >= _ONES[self.high[byte[open_]]]]
        place = 8 * byte + _PLACE[self.high[byte], left]
        low = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (self.low[at >> 3] >> (at & 7) & 1).astype(np.int64) << k
        return ((place - i) << self.low_bits) | low


def to_segment(ids: list[bytes], width: int) -> bytes:
    """Documents' ids, each already as little-endian integers of this width."""
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // width)
    code = EliasFano.of(ends)
    return _HEAD.pack(MAGIC, width, len(ids), int(ends[-1]) if len(ids) else 0, code.low_bits) + code.to_bytes() + b"".join(ids)


def from_segment(data: bytes) -> tuple[EliasFano, np.ndarray]:
    """The boundaries and all ids."""
    magic, width, documents, count, low_bits = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    code, rest = EliasFano.read(documents, low_bits, memoryview(data)[_HEAD.size :])
    ids = np.frombuffer(rest, {2: "<u2", 4: "<u4"}[width])
    if len(ids) != count:
        raise ValueError("a segment of token ids is cut short")
    return code, ids


_MARK = re.compile(rb"[.,](?<=[a-z].)(?=[ \t-\r]|\Z)")

# The one normaliser and splitter for which texts may be encoded word by word, as the library writes them.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def is_wordwise(settings: dict) -> bool:
    """Whether a tokenizer file's texts are the rows of their words: by WORDWISE, with a token's end marked, and no
    added token but those that `words` looks for.

    That splitter drops white space and splits at it before it looks at letters, and that normaliser joins nothing that
    ASCII white space parts and lowers case.
    """
    model = settings["model"]
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix"))
    added = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in settings.get("added_tokens", []))
    return bool(plain and added and not settings.get("truncation") and all(settings.get(k) == v for k, v in WORDWISE.items()))


class WordEncoder:
    """The library's ids of whole texts; word by word if the tokenizer file is found wordwise.

    Then a comma or full stop between a letter and white space is a piece of its own too. Words new to this process
    go through the library: those of letters many at once, told apart by the tokens that end a piece, others each by
    itself. With any other tokenizer file each text goes through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        with open(path, encoding="utf-8") as file:
            self.wordwise = is_wordwise(json.load(file))
        if not self.wordwise:  # as stored, a file may cut or pad
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}

    def _alone(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, encoded as one text."""
        (found,) = self.tokenizer.encode_batch_fast([b" ".join(words).decode("utf-8", "replace")], add_special_tokens=False)
        ids = np.array(found.ids, self.kind)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words) or cut[-1] != len(ids):
            return self._alone(words)
        data, at = ids.tobytes(), (cut * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def _learn(self, new: set[bytes]) -> None:
        plain = [w for w in new if w.isalpha() or w.decode("utf-8", "replace").isalpha()]
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            self.known.update(zip(part, self._together(part), strict=True))
        other = list(new.difference(plain))
        for i in range(0, len(other), 4096):
            self.known.update(zip(other[i : i + 4096], self._alone(other[i : i + 4096]), strict=True))

    @staticmethod
    def words(content: bytes) -> list[bytes]:
        """A text's words; where nothing forbids it, A-Z in lower case and marks behind letters apart."""
        if b"<|" in content or b"\xcc" in content or b"\xcd" in content:  # a special token, or a mark that joins a letter
            return content.split()
        return _MARK.sub(rb" \g<0>", content.lower()).split()

    def encode(self, contents: list[bytes]) -> list[bytes]:
        if not self.wordwise:
            return [x for i in range(0, len(contents), 64) for x in self._alone(contents[i : i + 64])]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        get = self.known.get
        split = [self.words(x) for x in contents]  # at ASCII white space
        found = [list(map(get, words)) for words in split]
        gaps = [list(compress(range(len(ids)), map(not_, ids))) for ids in found]
        self._learn({words[i] for words, at in zip(split, gaps, strict=True) for i in at})
        for words, ids, at in zip(split, found, gaps, strict=True):
            for i in at:
                ids[i] = get(words[i])
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One a process, so that words last from task to task."""
    return WordEncoder(path)


_SEGMENTS = "shard int, seq int, start_in_shard long, n_ids long, doc_ids array<long>, segment binary"
_SEGMENT_SCHEMA = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("segment", pa.binary())])


def write_ids(docs: DataFrame, tokenizer: str, end_id: int) -> str:
    """Write all documents' ids, end_id after each; gives the folder of the segments."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([end_id], f"<u{own.width}").tobytes()
        shard, start = TaskContext.get().partitionId(), 0
        for seq, block in enumerate(common.blocks(batches, most=SEGMENT)):
            ids = [x + end for x in own.encode(common.encoded(block.column("text")))]
            n = sum(map(len, ids)) // own.width
            row = {"shard": [shard], "seq": [seq], "start_in_shard": [start], "n_ids": [n], "doc_ids": [block.column("doc_id").to_pylist()], "segment": [to_segment(ids, own.width)]}
            yield from common.emit(row, _SEGMENT_SCHEMA)
            start += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    by = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("m")]
    ordered = rows.repartitionByRange(common.shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    folder = f"{common.shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    ordered.select("doc_id", "text").mapInArrow(run, _SEGMENTS).write.option("compression", "zstd").parquet(folder)
    return folder


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of every document in the files."""
    segments = spark.read.schema(_SEGMENTS).parquet(folder)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("shard_start", "start_in_shard", "doc_ids", "segment")}
                code, ids = from_segment(row["segment"])
                ends = code.select_many(np.arange(code.n))
                starts = np.concatenate(([0], ends[:-1]))
                data = ids.astype("<u4").tobytes()
                own = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = {"doc_id": row["doc_ids"], "start": starts + row["shard_start"] + row["start_in_shard"], "n_tokens": ends - starts, "ids": own}
                yield from common.emit(out, schema, 2000)

    # a row a range partition: the broadcast is bounded by their number
    return segments.join(F.broadcast(starts), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_some(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens and ids of the documents in doc_ids (a column doc_id), without unpacking others' boundaries.

    Segments without any of them aren't opened; null doc_ids are never asked for. Each boundary is one `select`.
    """
    places = spark.read.schema(_SEGMENTS).parquet(folder).select("shard", "seq", F.posexplode("doc_ids").alias("at", "doc_id"))
    wanted = places.join(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")
    wanted = wanted.groupBy("shard", "seq").agg(F.collect_list(F.struct("at", "doc_id")).alias("wanted"))  # no more than a segment has
    segments = spark.read.schema(_SEGMENTS).parquet(folder).select("shard", "seq", "segment").join(wanted, ["shard", "seq"])
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, some in zip(batch.column("segment").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                code, ids = from_segment(segment)
                ends = [(code.select(w["at"] - 1) if w["at"] else 0, code.select(w["at"])) for w in some]
                out = {"doc_id": [w["doc_id"] for w in some], "n_tokens": [b - a for a, b in ends], "ids": [ids[a:b].astype("<u4").tobytes() for a, b in ends]}
                yield from common.emit(out, schema, 2000)

    return segments.select("segment", "wanted").mapInArrow(run, "doc_id long, n_tokens long, ids binary")
