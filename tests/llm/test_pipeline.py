"""The pipeline stage by stage against brute force, on planted copies, near copies and shared passages."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline

from .test_corpus_operators import KINDS

STAGES = dict(corpus_pipeline.STAGES)


def prose(rnd, lang, n):
    vocabulary = {"en": "the of and to in that was with from this which have", "de": "der die und das mit nicht von sich auch eine werden"}[lang].split()
    rare = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(4, 9))) for _ in range(n)]
    return [rnd.choice(vocabulary) if rnd.random() < 0.5 else rnd.choice(rare) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(12), []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        out.append((i, " ".join(prose(rnd, lang, rnd.choice([40, 120, 300]))), lang, "s", 0))
    out += [(200 + k, out[3][1].upper() if k % 2 else out[3][1], "en", "s", 0) for k in range(5)]  # exact copies
    for k in range(4):  # near copies
        words = out[11][1].split()
        words[rnd.randrange(len(words))] = f"changed{k}"
        out.append((300 + k, " ".join(words), "en", "s", 0))
    passage = prose(rnd, "en", 60)
    out += [(400 + k, " ".join([*prose(rnd, "en", 80), *passage, *prose(rnd, "en", 80)]), "en", "s", 0) for k in range(3)]
    return out + [(500, None, "en", "s", 0), (501, "", None, None, None), (502, "123 ... 456", "en", "s", 0), (None, out[5][1], "de", None, None)]


@pytest.fixture(scope="module")
def stages(spark, rows, tmp_path_factory):
    docs, out = spark.createDataFrame(rows, KINDS), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, "").write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = before, docs
        assert name == "pack" or docs.columns == before.columns
    return out


def collected(df):
    return [tuple(r) for r in df.collect()]


def test_language(stages):
    before, after = map(collected, stages["language"])
    gone = Counter(before) - Counter(after)
    assert {r[0] for r in gone} == {500, 501, 502} and not Counter(after) - Counter(before)


def test_exact(stages):
    before, after = map(collected, stages["exact"])
    groups = {}
    for r in before:
        groups.setdefault(r[1].encode().lower(), []).append(r)
    best = Counter(max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values())
    assert Counter(after) == best


def test_near(stages):
    before, after = map(collected, stages["near"])
    shingles = {r: {tuple(r[1].lower().split()[i : i + 5]) for i in range(max(1, len(r[1].split()) - 4))} for r in before}
    label = {r: r for r in before}

    def top(x):
        while label[x] is not x:
            x = label[x]
        return x

    for x in before:
        for y in before:
            if x is not y and len(shingles[x] & shingles[y]) >= 0.8 * len(shingles[x] | shingles[y]):
                label[top(x)] = top(y)
    groups = {}
    for x in before:
        groups.setdefault(top(x), []).append(x)
    assert sum(len(g) > 1 for g in groups.values()) >= 1
    assert Counter(after) == Counter(min(g, key=lambda r: r[0]) for g in groups.values())


def test_substring(stages):
    before, after = map(collected, stages["substring"])
    words = {r: r[1].split() for r in before}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    left = {r[0]: r for r in after}
    assert len(left) == len(before)
    for r, w in words.items():
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r[1]
        assert left[r[0]] == (r[0], want, r[2], r[3], len(want) if gone else r[4])
    assert any(re.search("", r[1]) and len(r[1].split()) == 160 for r in after)  # the passage of 60 words is gone


def test_pack(stages):
    before, after = stages["pack"]
    assert Counter(collected(after.select(before.columns))) == Counter(collected(before))
    places = Counter((r.pack_bucket, r.pack_batch, r.pack_slot) for r in after.collect())
    assert max(places.values()) == 1


def test_run_over_the_smallest_tables(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    total = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0.5 * total < found.count() <= total


def test_empty(spark):
    docs = spark.createDataFrame([], KINDS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


@pytest.mark.parametrize("order", ["first", "last", "shuffled"])
def test_copies_alike_to_their_original_alone_all_join(spark, order):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(300):
        own = list(base)
        for at in rnd.sample(range(10, 190), 3):
            own[at] = f"c{rnd.random()}"
        texts.append(" ".join(own))
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in [*texts, " ".join(base)])]
    assert all(near(x, sets[-1]) for x in sets) and sum(near(x, sets[0]) for x in sets) < 60
    texts = {"first": [" ".join(base), *texts], "last": [*texts, " ".join(base)], "shuffled": rnd.sample([" ".join(base), *texts], 301)}[order]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], KINDS).coalesce(1)
    assert [r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()] == [0]


def test_contiguous_edits_are_found_as_brute_force_finds_them(spark):
    rnd, rows, alike = random.Random(6), [], set()
    fresh = lambda n: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(n)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for n in [100, 300] * 20:
        for kind in ("appended", "truncated", "replaced", "inserted"):
            words = fresh(n)
            copy = {"appended": words + fresh(n // 5), "truncated": words[: -n // 6], "replaced": words[:20] + fresh(n // 20) + words[20 + n // 20 :], "inserted": words[:50] + fresh(n // 3) + words[50:]}[kind]
            x, y = sets(words), sets(copy)
            if len(x & y) >= 0.8 * len(x | y):
                alike.add(len(rows) + 1)
            rows += [(len(rows), " ".join(words), "en", "s", 0), (len(rows) + 1, " ".join(copy), "en", "s", 0)]
    kept = {r.doc_id for r in corpus_pipeline.near(spark, spark.createDataFrame(rows, KINDS), "").collect()}
    assert 80 <= len(alike) < len(rows) // 2
    assert set(range(len(rows))) - kept == alike
