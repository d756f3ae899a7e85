"""Each registered query over a folder of odd rows, digests and all, against brute force written from the contract."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftscope.llm import byte_bpe, language_id, media, packing, queries

from .test_corpus_operators import TestExactDedup, TestSimHash, odd_rows
from .test_more_operators import TestBrown

QUERIES = queries.queries()
SHARED = " ".join(f"s{k}" for k in range(50))
ROWS = [*odd_rows(), (700, f"before {SHARED} after"), (701, f"{SHARED}"), (702, f"x y {SHARED} z z"), (None, SHARED), (703, "und die der das ist nicht"), (704, "the and of which is not")]
LANG = {703: "de", 704: "en", 5: "en", 6: "de", 20: "en", 21: "de", 22: "en"}
#: Columns whose names clash with what operators call their own.
CLASHES = ["__key", "__id", "__text", "__lang", "__score", "__hash", "__doc", "c0", "found", "best", "odds", "key", "fp", "h", "m", "block", "pack_batch", "keep_id", "ids", "media"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, LANG.get(i), "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(7) for c in CLASHES}).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def data(t):
    return (t or "").encode()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def crc(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def test_op1(spark, folder):
    """Naive Bayes with the n-grams, the hash and the sums spelled out."""
    mult, mask = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], 2**32 - 1

    def bucket(gram):
        h = (ord(gram[0]) * mult[0] + len(gram)) & mask
        for k, c in enumerate(gram[1:], 1):
            h = ((h ^ h >> 15) * mult[k] + ord(c)) & mask
        h ^= h >> 13
        return (h * mult[4] & mask) >> 16

    def grams(t):
        folded = re.sub(r"\s+", " ", f" {t.lower()} ")
        return [bucket(folded[i : i + n]) for n in (1, 2, 3) for i in range(len(folded) - n + 1)]

    counts = {}
    for i, t in ROWS:
        if t is not None and LANG.get(i) and crc(i, 5):
            counts.setdefault(LANG[i], Counter()).update(grams(t))
    langs = sorted(counts)
    assert len(langs) == 2
    total = {x: sum(counts[x].values()) + 0.5 * 65536 for x in langs}
    want = []
    for i, t in ROWS:
        if not any(c.isalpha() for c in t or ""):
            want.append((i, crc(i, 5) == 0, "und", 0.0))
            continue
        own = grams(t)
        mean = [sum(math.log((counts[x][b] + 0.5) / total[x]) for b in own) / len(own) for x in langs]
        best = max(range(2), key=lambda k: (mean[k], -k))
        want.append((i, crc(i, 5) == 0, langs[best], 1 / sum(math.exp(20 * (m - mean[best])) for m in mean)))
    found = rows_of(QUERIES["op1_language_id"](spark, folder))
    want.sort(key=repr)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in found], [r[3] for r in want], atol=1e-3)


def test_op2(spark, folder):
    def feature(payload):
        x = np.frombuffer(payload, np.uint8).astype(np.float64)
        x = x - x.mean()
        edge = media.FRAME - media.HOP
        x = np.concatenate([np.zeros(edge), x, np.zeros(edge)])
        frames = max(1, -(-(len(x) - media.FRAME) // media.HOP) + 1)
        x = np.concatenate([x, np.zeros((frames - 1) * media.HOP + media.FRAME - len(x))])
        turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME), np.arange(media.FRAME // 2 + 1)) / media.FRAME)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
        return x, frames, turn, window

    found = {r.payload_sha256: r for r in QUERIES["op2_media"](spark, folder).collect()}
    for _, t in ROWS:
        payload = data(t) + bytes(-len(data(t)) % 64 or (0 if t else 64))
        r = found[hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data(t)), len(payload), zlib.crc32(payload[-64:]))
        wav = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + bytes([1, 0, 1, 0]) + (8000).to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0]) + b"data" + len(payload).to_bytes(4, "little") + payload
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        if len(payload) > 3000:
            continue
        x, frames, turn, window = feature(payload)
        marks = [tuple(map(int, m.split(":"))) for m in r.feature.split()]
        assert marks == sorted(marks)
        levels = [np.abs((x[f * media.HOP : f * media.HOP + media.FRAME] * window) @ turn) ** 2 for f in range(frames)]
        for at, code in marks:  # both ends of each pair are peaks, none stronger left out but those kept
            for f, bin_ in ((at, code >> 12), (at + (code & 3), code >> 2 & 1023)):
                own = levels[f]
                peaks = [k for k in range(1, len(own) - 1) if own[k] > own[k - 1] * 0.999 and own[k] > own[k + 1] * 0.999]
                assert bin_ in peaks
                sure = [k for k in range(1, len(own) - 1) if own[k] > own[k - 1] * 1.001 and own[k] > own[k + 1] * 1.001]
                assert sum(own[k] > own[bin_] * 1.001 for k in sure) < media.PEAKS
    assert len({r.feature for r in found.values() if r.n_bytes}) > 0.9 * len([r for r in found.values() if r.n_bytes])


def test_op3(spark, folder):
    assert rows_of(QUERIES["op3_simhash"](spark, folder)) == TestSimHash().components(ROWS)


def test_op4(spark, folder):
    found = QUERIES["op4_packing"](spark, folder).collect()
    lengths = [max(1, len(words(t))) for _, t in ROWS]
    ends = packing.boundaries(*np.unique(lengths, return_counts=True)).tolist()
    assert sorted(((r.doc_id, r.pack_tokens, r.pack_length) for r in found), key=repr) == sorted(((i, n, next(e for e in ends if e >= n)) for (i, _), n in zip(ROWS, lengths, strict=True)), key=repr)
    assert len({(r.pack_bucket, r.pack_batch, r.pack_slot) for r in found}) == len(ROWS)
    for r in found:
        assert r.pack_slot < max(1, packing.BUDGET // r.pack_length)


def test_op5(spark, folder):
    every = [words(t) for _, t in ROWS]
    seen = Counter(tuple(w[k : k + 35]) for w in every for k in range(len(w) - 34))
    want = []
    for (i, _), w in zip(ROWS, every, strict=True):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows_of(QUERIES["op5_recompression"](spark, folder)) == sorted(want, key=repr)


def test_op7(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = sorted(QUERIES["op7_token_files"](spark, folder).collect(), key=lambda r: r.start)
    own = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    want = Counter((i, len(own(t)), zlib.crc32(own(t).tobytes())) for i, t in ROWS)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    assert [r.doc_id for r in found] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]


def test_op8(spark, folder):
    found = QUERIES["op8_brown"](spark, folder).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == TestBrown().expected(ROWS)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)


def test_op9(spark, folder):
    assert rows_of(QUERIES["op9_grace_dedup"](spark, folder)) == TestExactDedup().expected(ROWS)


def test_op10(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t in ROWS:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(data(t)).hexdigest()))
    assert rows_of(QUERIES["op10_byte_bpe"](spark, folder)) == sorted(want, key=repr)


def test_languages_beyond_one_group_of_the_matrix(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = lambda: rows_of(language_id.predict(docs, language_id.fit(docs.filter("lang is not null")), ["doc_id"]).select("doc_id", "lang_pred", F.round("score", 6)))
    whole = own()
    monkeypatch.setattr(language_id, "GROUP", 1)
    assert own() == whole
