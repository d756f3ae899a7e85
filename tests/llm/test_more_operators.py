"""Packing, tool calls, token files and the class-based model against brute force, nulls and repeats included."""

import itertools
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftscope.llm import brown, chat, language_id, packing, token_files

from .test_corpus_operators import odd_rows, table

WORDS = public_tokenizers.path("word_bpe_49k.json")


class TestPacking:
    def padded(self, lengths, ends):
        return sum(next(e for e in ends if e >= x) for x in lengths)

    def test_boundaries_are_optimal(self):
        rnd = random.Random(4)
        for _ in range(200):
            lengths = [rnd.choice([1, 2, 3, 5, 8, 40, 41, 100]) if rnd.random() < 0.5 else rnd.randint(1, 60) for _ in range(rnd.randint(1, 30))]
            own, counts = np.unique(lengths, return_counts=True)
            k = rnd.randint(1, 4)
            ends = packing.boundaries(own, counts, k)
            assert len(ends) <= k and ends[-1] == own[-1] and (np.diff(ends) > 0).all()
            best = min(self.padded(lengths, [*some, own[-1]]) for n in range(min(k, len(own))) for some in itertools.combinations(own[:-1].tolist(), n))
            assert self.padded(lengths, ends.tolist()) == best

    @pytest.mark.parametrize("budget", [64, 40_000])
    def test_batches(self, spark, budget):
        rows = odd_rows() + [(None, "a b"), (None, "a b")]
        docs = table(spark, rows).withColumn("pack_batch", F.lit("clash"))
        found = packing.pack(docs, ["doc_id", "lang"], buckets=4, budget=budget).collect()
        assert sorted(((r.doc_id, r.pack_tokens) for r in found), key=repr) == sorted(((i, max(1, len((t or "").encode().split()))) for i, t in rows), key=repr)
        batches = defaultdict(list)
        for r in found:
            assert r.pack_tokens <= r.pack_length
            batches[r.pack_bucket, r.pack_batch].append(r)
        lengths = sorted({r.pack_length for r in found})
        assert lengths == packing.boundaries(*np.unique([r.pack_tokens for r in found], return_counts=True), 4).tolist()
        for (bucket, batch), rows_of in batches.items():
            room = max(1, budget // rows_of[0].pack_length)
            last = max(b for k, b in batches if k == bucket)
            assert sorted(r.pack_slot for r in rows_of) == list(range(len(rows_of)))
            assert len(rows_of) == room if batch < last else len(rows_of) <= room
        for bucket in {k for k, _ in batches}:
            ids = [r.doc_id for r in sorted((r for r in found if r.pack_bucket == bucket), key=lambda r: (r.pack_batch, r.pack_slot))]
            assert ids == sorted(ids, key=lambda i: (i is not None, i))

    def test_empty_table(self, spark):
        assert packing.pack(table(spark, []), ["doc_id"]).count() == 0
        assert len(packing.boundaries(np.zeros(0), np.zeros(0))) == 0


class TestToolCalls:
    CALLS = "conv_id long, call_id string, parent_id string, name string, arguments string, extra int"
    RESULTS = "conv_id long, call_id string, content string, state string"
    SCHEMA = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 0, "maximum": 9}, "y": {"type": "array", "items": {"enum": ["a", "b"]}}}}}

    def linked(self, spark, calls, results):
        return chat.link(spark.createDataFrame([(*c, 1) for c in calls], self.CALLS), spark.createDataFrame([(*r, "clash") for r in results], self.RESULTS), self.SCHEMA)

    def test_states_depths_and_json(self, spark):
        chain = [(1, f"c{k}", f"c{k - 1}" if k else None, "f", '{"x": 1}') for k in range(37)]
        calls = [*chain, (2, "a", "gone", "f", '{"y":["b"],"x":1.0}'), (2, "p", "q", "f", "{}"), (2, "q", "p", "f", '{"x":11,"z":0}'), (2, "r", "q", "g", "1"), (None, "a", None, "f", "not json"), (3, None, None, "f", None), (2, "a", None, "f", '{"x": 9, "x2": 1}')]
        results = [(1, "c3", "ok\né"), (1, "c3", "zz"), (2, "a", None), (9, "a", "lost"), (None, "a", "mine"), (4, None, "nobody")]
        found = {(r.conv_id, r.call_id): r for r in self.linked(spark, calls, results).collect()}
        assert [found[1, f"c{k}"].depth for k in range(37)] == list(range(37))
        assert {k: found[2, k].depth for k in "apqr"} == {"a": 0, "p": chat.CYCLE, "q": chat.CYCLE, "r": chat.CYCLE}
        assert found[1, "c3"].json == '{"arguments":{"x":1},"call_id":"c3","name":"f","result":"ok\\né","state":"linked","valid":true}'
        assert (found[1, "c3"].n_results, found[1, "c4"].state, found[9, "a"].state, found[9, "a"].valid) == (2, "pending", "orphan", None)
        assert found[2, "a"].n_calls == 2 and found[2, "a"].problems == ["$.x2: not known"] and json.loads(found[2, "a"].json)["result"] is None
        assert found[2, "q"].problems == ["$.x: too large", "$.z: not known"] and found[2, "p"].problems == ["$.x: missing"] and found[2, "r"].problems == ["$: no such tool"]
        assert found[None, "a"].problems == ["$: not JSON"] and found[None, "a"].state == "linked"
        assert found[3, None].state == "pending" and found[4, None].state == "orphan"
        assert len(found) == len({c[:2] for c in calls} | {r[:2] for r in results})

    def test_canonical_numbers(self):
        assert chat.canonical({"b": [1.0, 2.5, 1e300], "a": "€\u0001"}) == '{"a":"€\\u0001","b":[1,2.5,1e+300]}'

    def test_empty(self, spark):
        assert self.linked(spark, [], []).count() == 0

    def test_turns(self, spark):
        rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", None), (1, 4, "user", ""), (1, 5, None, "x"), (2, 1, "assistant", None), (None, None, "user", "y")]
        calls, results = chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        found = {(r.conv_id, r.call_id): (r.state, r.depth, r.valid) for r in chat.link(calls, results, chat.SCHEMAS).collect()}
        assert found == {(1, "1:0"): ("linked", 0, True), (1, "1:2"): ("pending", 1, False), (1, "1:4"): ("pending", 2, False), (2, "2:0"): ("orphan", None, None), (None, None): ("pending", 0, False)}


class TestTokenFiles:
    def test_select(self):
        rnd = random.Random(2)
        for n in (0, 1, 2, 63, 64, 65, 500):
            for most in (0, 1, 5, 3000):
                values = np.cumsum([rnd.randint(0, most) for _ in range(n)]).astype(np.int64)
                code = token_files.EliasFano.of(values)
                again, rest = token_files.EliasFano.read(n, code.low_bits, memoryview(code.to_bytes() + b"rest"))
                assert bytes(rest) == b"rest"
                assert [again.select(i) for i in range(n)] == values.tolist()
                assert again.select_many(np.arange(n)).tolist() == values.tolist()
                if n == 500 and most == 3000:
                    assert len(code.to_bytes()) < 500 * 3

    def test_round_trip(self, spark, monkeypatch):
        monkeypatch.setattr(token_files, "SEGMENT", 3000)
        rows = odd_rows()
        library = Tokenizer.from_file(WORDS)
        folder = token_files.write_ids(table(spark, rows), WORDS, 1)
        found = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
        want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
        assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found) == want
        assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]

    def test_words_as_the_library(self):
        library, own, rnd = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS), random.Random(1)
        letters = [*"aAbZJ.,;:'’sß\n\t \r\x0b\x1c\x85 ​éÉ12½ΣςİſK<|>", "<|endoftext|>", "<|ENDOFTEXT|>", "J̌", "é", "'S", "'ll", "…", ". ", ", ", "中", "\U0001f600"]
        texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(3000)]
        found = own.encode([x.encode() for x in texts])
        assert [np.frombuffer(x, own.kind).tolist() for x in found] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]

    def test_empty_table(self, spark):
        assert token_files.read_ids(spark, token_files.write_ids(table(spark, []), WORDS, 1)).count() == 0


class TestBrown:
    def expected(self, rows):
        tokens = [[*(t or "").encode().lower().split(), b" "] for _, t in rows]
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
        counts = Counter(w for own, out in zip(tokens, held, strict=True) if not out for w in own)
        total, distinct = sum(counts.values()), len(counts)
        return sorted(((i, out, len(own), sum(w in counts for w in own), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), 6)) for (i, _), own, out in zip(rows, tokens, held, strict=True)), key=repr)

    @pytest.mark.parametrize("block,piece", [(28 << 20, 2 << 20), (3000, 500)])
    def test_counts_and_base(self, spark, monkeypatch, block, piece):
        monkeypatch.setattr(brown, "BLOCK", block)
        monkeypatch.setattr(brown, "PIECE", piece)
        rows = odd_rows()
        found = brown.score(table(spark, rows), language_id.crc_part("doc_id", 7) == 2, classes=8, contexts=12, rounds=2).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == self.expected(rows)
        assert all(r.score <= 0 and math.isfinite(r.score) for r in found)
        assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9) for r in found)

    def test_score_is_the_model(self, spark):
        rows = odd_rows()
        docs, held = table(spark, rows), F.lit(False)
        numbered = brown.blocks(docs, held).cache()
        contexts = brown.Contexts([r["name"] for r in brown.vocabulary(numbered).orderBy(F.desc("n"), "name").limit(12).collect()])
        words = {r["name"]: (r["n"], r["class"]) for r in brown.word_classes(brown.context_vectors(docs, held, contexts), contexts, 8, 2).collect()}
        digest = lambda w: brown.xxhash.xxh64_intdigest(w) - (1 << 64 if brown.xxhash.xxh64_intdigest(w) >> 63 else 0)
        texts = {i: [*(t or "").encode().lower().split(), b" "] for i, t in rows if i is not None and i >= 10}
        sizes = Counter()
        for n, k in words.values():
            sizes[k] += n
        counts = Counter(w for _, t in rows for w in [*(t or "").encode().lower().split(), b" "])
        assert {digest(w): n for w, n in counts.items()} == {k: n for k, (n, _) in words.items()}
        moved = np.zeros((9, 9))
        for _, t in rows:
            before, once_before = 7, False
            for w in [*(t or "").encode().lower().split(), b" "]:
                n, k = words[digest(w)]
                moved[before, k] += 1
                moved[before, 8] += n == 1
                moved[8, k] += once_before
                moved[8, 8] += once_before and n == 1
                before, once_before = k, n == 1
        share = moved.sum(axis=0) + 1
        logs = moved + brown.MIXED * share / share.sum()
        logs = np.log10(logs / logs.sum(axis=1, keepdims=True))
        assert np.allclose((10**logs).sum(axis=1), 1)
        found = {r.doc_id: r.score for r in brown.score(docs, held, classes=8, contexts=12, rounds=2).collect()}
        for i, own in texts.items():
            total, before = 0.0, 7
            for w in own:
                n, k = words[digest(w)]
                total += logs[before, k] + math.log10(n / sizes[k])
                before = k
            assert math.isclose(found[i], total, rel_tol=1e-9, abs_tol=1e-9)

    def test_classes_help(self, spark):
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        per = lambda rounds: brown.score(docs, language_id.crc_part("doc_id", 7) == 2, rounds=rounds).filter("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("own"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).first()
        none, some = per(0), per(3)
        assert some.own > none.own > some.base

    def test_gain_of_each_word_by_sums_over_its_entries(self):
        rnd = np.random.default_rng(4)
        matrix = rnd.integers(0, 500, (8, 18))
        known = brown.Round(np.zeros(12, np.int64), matrix, matrix[:, :9].sum(axis=1))
        sizes = rnd.integers(1, 19, 300)
        column = np.concatenate([np.sort(rnd.permutation(18)[:n]) for n in sizes])
        x = np.where(rnd.random(len(column)) < 0.8, rnd.integers(1, 6, len(column)), rnd.integers(1, 3000, len(column)))
        heads = sizes.cumsum() - sizes
        xlogx = lambda v: v * np.log(np.maximum(v, 1))
        want = [sum(xlogx(matrix[:, column[e]] + x[e]) - xlogx(matrix[:, column[e]]) for e in range(a, a + n)) for a, n in zip(heads, sizes)]
        assert {1, brown.FEW, brown.FEW + 1} <= set(range(1, x.max() + 1)) and (x > brown.FEW).any()
        assert np.allclose(known.gain(column, x, heads), np.array(want), rtol=1e-4, atol=1e-2)

    def test_nothing_to_learn(self, spark):
        assert brown.score(table(spark, []), F.lit(False)).count() == 0
        found = brown.score(table(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
        assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
