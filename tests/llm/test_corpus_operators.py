"""Each operator against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from shiftscope.llm import byte_bpe, exact_dedup, language_id, media, simhash

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KINDS)


def odd_rows():
    rnd = random.Random(7)
    words = ["the", "of", "Über", "día", "x1", "42", "…", "🙂", "naïve", "end."]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "ONE"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, "É"), (7, "é")]
    rows += [(10 + i, rnd.choice([" ", "\n", "  ", "\r\n"]).join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(60)]
    rows += [(100, "word " * 30_000), (101, "x" * 50_000), (102, rows[20][1]), (103, rows[20][1].upper())]
    return rows


def as_bytes(text):
    return (text or "").encode()


class TestExactDedup:
    def expected(self, rows):
        groups = defaultdict(list)
        for i, t in rows:
            groups[as_bytes(t).lower()].append(i)
        out = []
        for content, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            out += [(i, keep, len(ids), i == keep, hashlib.sha256(content).hexdigest()) for i in ids]
        return sorted(out, key=repr)

    @pytest.mark.parametrize("bucket_bytes", [1 << 26, 2000])
    def test_groups(self, spark, bucket_bytes):
        rows = odd_rows()
        found = exact_dedup.groups(table(spark, rows), bucket_bytes)
        assert sorted(map(tuple, found.collect()), key=repr) == self.expected(rows)

    def test_one_row_stays(self, spark):
        rows = odd_rows()
        found = exact_dedup.deduplicate(table(spark, rows))
        assert found.columns == KINDS.replace(" long", "").replace(" string", "").split(", ")
        assert sorted(as_bytes(r.text).lower() for r in found.collect()) == sorted({as_bytes(t).lower() for _, t in rows})
        assert {r.doc_id for r in found.collect()} == {e[1] for e in self.expected(rows)}

    def test_empty_table(self, spark):
        assert exact_dedup.groups(table(spark, [])).count() == 0
        assert exact_dedup.deduplicate(table(spark, [])).count() == 0

    def test_a_hot_text_and_one_that_shares_its_hash(self, spark, monkeypatch):
        monkeypatch.setattr(exact_dedup.xxhash, "xxh64_intdigest", lambda x: 7 if x.startswith(b"hot") else hash(x) & (2**63 - 1))
        monkeypatch.setattr(exact_dedup.common, "HOT_ROWS", 10)
        rows = [(i, "Hot text") for i in range(2000)] + [(5000 + i, "hot other") for i in range(40)] + [(9000 + i, f"x{i}") for i in range(500)]
        random.Random(2).shuffle(rows)
        blocks = exact_dedup.common.blocks
        monkeypatch.setattr(exact_dedup.common, "blocks", lambda batches, by="text", most=0: blocks(batches, by, 200))
        pending = spark.createDataFrame([(t, i, 7 if t.lower().startswith("hot") else i, [i], len(t)) for i, t in rows], "__text string, __id long, __hash long, __members array<long>, __bytes long")
        monkeypatch.setattr(exact_dedup, "local_groups", lambda docs, payload: pending)
        found = exact_dedup.groups(table(spark, rows), 1000)
        assert sorted(map(tuple, found.collect()), key=repr) == self.expected(rows)
        apart, same = exact_dedup._hot_apart(pending, 1000, 1000)
        assert {r[0] for r in same.select("__text").distinct().collect()} in ({"Hot text"}, {"hot other"}) and apart.count() + same.count() == len(rows)

    def test_equal_hashes_stay_apart(self):
        own = exact_dedup.ContentTable(4)
        assert [own.ordinal(5, b"a"), own.ordinal(5, b"b"), own.ordinal(5, b"a"), own.ordinal(9, b"c")] == [(0, True), (1, True), (0, False), (2, True)]


class TestByteBpe:
    @pytest.fixture(scope="class")
    def reference(self):
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})

    def test_as_the_library(self, spark, reference):
        rows = odd_rows()
        encoded = byte_bpe.encode(table(spark, rows), PATH, PATTERN)
        found = byte_bpe.decode(encoded, PATH).collect()
        assert sorted(found, key=repr) == sorted(byte_bpe.encode(table(spark, rows), PATH, PATTERN, decoded=True).collect(), key=repr)
        assert sorted(((r.doc_id, r.text, np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=repr) == sorted(((i, t or "", reference.encode_ordinary(t or "")) for i, t in rows), key=repr)

    def test_random_texts(self, reference):
        own, rnd = byte_bpe.codec(PATH, byte_bpe.split_rule(PATTERN)), random.Random(3)
        letters = list(string.printable) + list("éßñçüøЖя中文日本語한국어😀👩‍💻ा́ 　 \x1c\x85")
        for _ in range(3000):
            text = "".join(rnd.choices(letters, k=rnd.randint(0, 30)))
            ids = np.frombuffer(own.encode(text), "<u4").tolist()
            assert ids == reference.encode_ordinary(text)
            assert byte_bpe.decoder(PATH).decode(ids) == text

    def test_streamed_decoding_replaces_what_is_invalid(self):
        own = byte_bpe.Utf8Decoder({i: bytes([i]) for i in range(256)})
        for data in (b"a\xffb", b"\xe2\x82", b"\xe2\x82\xac", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80\xc3", b"\xc3("):
            assert own.decode(list(data)) == data.decode("utf-8", "replace")

    def test_small_caches_give_the_same(self, monkeypatch, reference):
        monkeypatch.setattr(byte_bpe, "KEPT_STATES", 50)
        monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 5)
        own = byte_bpe.Codec(PATH, byte_bpe.split_rule(PATTERN))
        for _, text in odd_rows():
            assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == reference.encode_ordinary(text or "")


class TestMedia:
    def test_round_trip(self, spark):
        rows = odd_rows()
        found = media.features(media.store(table(spark, rows))).withColumn("feature", media.feature_text())
        got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found.collect()}
        want = set()
        for i, t in rows:
            data = as_bytes(t)
            payload = data + bytes((-len(data)) % 64 or (0 if data else 64))
            want.add((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
        assert got == want
        assert all(r.media_bytes == r.payload_bytes + 44 for r in found.collect())

    def test_peaks_of_a_tone(self):
        t = np.arange(8 * media.FRAME)
        tone = 127 + 100 * np.sin(2 * np.pi * 37 * t / media.FRAME)
        assert (media.peaks(tone)[:, 0] == 37).all()
        times, codes = media.landmarks(tone)
        assert len(times) and (np.diff(times) >= 0).all()
        assert {c >> 12 for c in codes if (c >> 2) & 1023 == 37} >= {37}

    def test_short_texts_differ_and_shifted_copies_share_landmarks(self):
        rnd = random.Random(4)
        marks = lambda data: media.landmarks(np.frombuffer(media.from_wav(media.to_wav(data)[0]), np.uint8))
        text = lambda n: "".join(rnd.choices(string.ascii_lowercase + " ", k=n)).encode()
        short = {text(rnd.randint(20, 500)) for _ in range(300)}
        found = {tuple(map(tuple, marks(x))) for x in short}
        assert len(found) == len(short) and all(len(t) for t, _ in found)
        assert not len(marks(b"")[0])
        whole, inserted = text(4000), text(media.HOP * 3)
        t, code = marks(whole)
        late = set(zip(t.tolist(), code.tolist(), strict=True))
        t, code = marks(whole[:2000] + inserted + whole[2000:])
        assert len(late & {(a - 3, b) for a, b in zip(t.tolist(), code.tolist(), strict=True)}) > 0.3 * len(late)
        t, code = marks(whole[:2000] + b"x" + whole[2000:])
        assert len(late & set(zip(t.tolist(), code.tolist(), strict=True))) > 0.4 * len(late)


class TestLanguageId:
    def test_held_out_accuracy(self, spark):
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language_id.crc_part("doc_id", 5) == 0)
        model = language_id.fit(docs.filter("not held_out"))
        found = language_id.predict(docs, model, ["doc_id", "lang", "held_out"]).filter("held_out").collect()
        assert len(found) > 100
        assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.97

    def test_undetermined(self, spark):
        docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 ½ …", "de"), (4, "Ⅷ", None), (5, "and the", "en"), (6, "und die", "de"), (None, "und die", "de")], "doc_id long, text string, lang string")
        found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.fit(docs), ["doc_id"]).collect()}
        assert {k for k, (x, _) in found.items() if x == "und"} == {1, 2, 3, 4}
        assert found[5][0] == "en" and found[6][0] == found[None][0] == "de"
        assert {r.doc_id for r in language_id.accepted(docs).collect()} == {5, 6, None}
        nothing = docs.filter("false")
        assert language_id.predict(docs, language_id.fit(nothing), ["doc_id"]).filter("lang_pred = 'und'").count() == 7


class TestSimHash:
    def fingerprint(self, text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    def components(self, rows):
        fps = [self.fingerprint(t) for _, t in rows]
        label = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    a, b = label[i], label[j]
                    label = [a if x == b else x for x in label]
        least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in set(label)}
        return sorted(((rows[i][0], f"{fps[i]:016x}", least[label[i]]) for i in range(len(rows))), key=repr)

    @pytest.mark.parametrize("most", [4096, 3])
    def test_against_all_pairs(self, spark, most):
        rnd, rows = random.Random(5), odd_rows()
        base = rnd.choices(["alpha", "beta", "gamma", "delta", "eps"], k=400)
        for i in range(40):
            words = list(base)
            words[rnd.randrange(400)] = f"w{i}"
            rows.append((1000 + i, " ".join(words)))
        found = simhash.near_duplicates(table(spark, rows), most=most).withColumn("hex", simhash.hex_column())
        assert sorted(((r.doc_id, r.hex, r.component_id) for r in found.collect()), key=repr) == self.components(rows)

    def test_a_hot_fingerprint_and_a_large_component(self, spark, monkeypatch):
        from shiftscope.llm import common

        monkeypatch.setattr(common, "HOT_ROWS", 10)
        copies = spark.range(100_000).selectExpr("id doc_id", "'One Two three four' text")
        chain = spark.range(64).selectExpr("id + 200000 doc_id", "concat('a b c d', string(id)) text")
        found = simhash.near_duplicates(copies.unionByName(chain)).filter("doc_id < 100000").agg({"component_id": "max", "doc_id": "count"}).first()
        assert (found["max(component_id)"], found["count(doc_id)"]) == (0, 100_000)
        # 100,000 nodes in one component: a star of stars
        edges = spark.range(1, 100_000).selectExpr("id a", "if(id < 300, 0L, id % 300) b")
        assert simhash.components(edges).agg({"label": "max", "node": "count"}).first().asDict() == {"max(label)": 0, "count(node)": 100_000}

    def test_crowded_shards_lose_nothing(self, spark):
        rnd = random.Random(3)
        values = {sum(1 << b for b in rnd.sample(range(20), 10)) << 3 for _ in range(1500)}
        fps = spark.createDataFrame([(v,) for v in values], "fp long")
        found = {r.node: r.label for r in simhash.components(simhash.links(fps, most=30)).collect()}
        label = {v: v for v in values}
        for x in sorted(values):
            for a, b in ((a, b) for a in range(3, 23) for b in range(a)):
                y = x ^ (1 << a) ^ (1 << b)
                if y in label and label[x] != label[y]:
                    one, two = label[x], label[y]
                    label = {k: min(one, two) if c in (one, two) else c for k, c in label.items()}
        sizes = {c: list(label.values()).count(c) for c in set(label.values())}
        assert found == {v: c for v, c in label.items() if sizes[c] > 1}

    def test_tree_finds_what_all_pairs_find(self):
        rnd = random.Random(1)
        values = list({sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(600)})
        tree = simhash.BKTree()
        for v in values:
            tree.add(v)
        for q in values[:100]:
            assert sorted(tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)

    def test_empty_table(self, spark):
        assert simhash.near_duplicates(table(spark, [])).count() == 0
        assert simhash.one_of_each(table(spark, [])).count() == 0


class TestSimilarDocuments:
    def shingles(self, text):
        words = as_bytes(text).lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    def rows(self):
        rnd = random.Random(8)
        vocabulary = ["".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(2, 8))) for _ in range(900)]
        rows = [(None, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A b"), (5, "c")]
        for base in range(12):
            words = rnd.choices(vocabulary, k=rnd.choice([30, 120, 400]))
            for copy in range(rnd.randint(1, 6)):
                own = list(words)
                for _ in range(rnd.choice([0, 1, 1, 2, 4, 9])):
                    own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
                rows.append((100 + 10 * base + copy, " ".join(own)))
        rows += [rows[10], (None, rows[11][1]), (900, "x " * 40_000), (901, "x " * 39_999)]
        return rows

    def test_links_are_verified_and_few_are_lost(self, spark):
        rows = self.rows()
        sets = {r: self.shingles(r[1]) for r in rows}
        alike = lambda x, y: sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
        label = {r: r for r in sets}

        def top(x):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in ((x, y) for x in sets for y in sets if x is not y and alike(x, y)):
            label[top(x)] = top(y)
        groups = defaultdict(set)
        for x in sets:
            groups[top(x)].add(x[0])
        whole = {frozenset(g) for g in groups.values() if len(g) > 1}
        found = defaultdict(set)
        for r in simhash.similar_documents(table(spark, rows)).collect():
            found[r.component_id].add(r.doc_id)
        assert all(any(g <= w for w in whole) for g in found.values())  # nothing that isn't alike
        assert sum(map(len, found.values())) >= 0.95 * sum(map(len, whole))
        assert all(min(i for i in g if i is not None) == c for c, g in found.items())

    def test_simhashes_of_all_shingles_and_of_samples(self):
        own = simhash.shingles(" ".join(f"w{i % 700}" for i in range(900)).encode(), 5)
        samples = simhash.sampled(own)
        assert samples.shape == (32, 5) and set(samples.ravel().tolist()) <= set(own.tolist())
        assert all((simhash._FACTORS * simhash._BACK) == 1)
        for i, picked in enumerate(samples.ravel()):
            mapped = (own ^ simhash._SALTS[i]) * simhash._FACTORS[i]
            assert own[mapped.argmin()] == picked
        majority = lambda h: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.simhashes(own).tolist() == [majority(own.tolist()), *(majority(x) for x in samples.tolist())]

    @pytest.mark.parametrize("most", [4096, 20])
    def test_trees_link_the_fingerprints_of_each_kind(self, spark, most):
        rnd, rows = random.Random(9), set()
        for kind in (0, 1, 32):
            for _ in range(60):
                base = rnd.getrandbits(64) if rnd.random() < 0.7 else 0
                rows |= {(kind, base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3)))) for _ in range(4)}
        signed = lambda x: x - (x >> 63 << 64)
        rows = sorted(rows)
        near = [(x, y) for x in rows for y in rows if x < y and x[0] == y[0] and (x[1] ^ y[1]).bit_count() <= 2]
        # its own kind's apart, a document's fingerprints are like no other's
        fps = [[signed(fp if k == kind else rnd.getrandbits(64)) for k in range(33)] for kind, fp in rows]
        marked = spark.createDataFrame([(i, 9, x) for i, x in enumerate(fps)], "node long, n_shingles int, fps array<long>")
        groups = defaultdict(set)
        for r in simhash.candidates(marked, most=most).collect():
            groups[r.sig].add(rows[r.key])
        met = {frozenset((x, y)) for g in groups.values() for x in g for y in g if x != y}
        assert len(near) > 100 and {frozenset(p) for p in near} <= met
        assert all(x[0] == y[0] for x, y in map(tuple, met))

    def test_one_of_each(self, spark):
        rows = self.rows()
        kept = simhash.one_of_each(table(spark, rows)).collect()
        left = {r.doc_id for r in kept}
        gone = {r.doc_id for r in simhash.similar_documents(table(spark, rows)).filter("not doc_id <=> component_id").collect()}
        assert len(gone) > 5 and left == {i for i, _ in rows} - gone | ({None} if None in left else set())
        assert {1, 2, 3, 5, None} <= left
        assert simhash.one_of_each(table(spark, [])).count() == 0
