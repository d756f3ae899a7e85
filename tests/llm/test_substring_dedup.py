"""Recompression against brute force: every repeated window, and nothing else."""

import random
from collections import Counter

import numpy as np
import pytest

from shiftscope.llm import substring_dedup as sd

KINDS = "doc_id long, text string, lang string, n_chars long, kept string"


def expected(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def random_rows(seed, vocabulary, n=40):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [rnd.choices(words, k=rnd.randint(4, 60)) for _ in range(6)] + [["a"] * 30, ["a", "b"] * 20]
    rows = [(None, None), (0, ""), (1, " \n "), (2, "single")]
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            parts += rnd.choice(passages) if rnd.random() < 0.5 else rnd.choices(words, k=rnd.randint(0, 40))
        rows.append((10 + i, rnd.choice([" ", "\n", "\t \r\n"]).join(parts)))
    rows += [rows[5], rows[5], (500, rows[6][1]), (None, rows[7][1]), (None, rows[7][1]), (501, "a " * 3000), (502, "x y z " * 500), (503, " ".join(rnd.choices(words, k=3000)))]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", len(t or ""), "clash") for i, t in rows], KINDS)


@pytest.mark.parametrize("seed,vocabulary,window,block", [(1, 2, 8, 1 << 20), (2, 3, 12, 300), (3, 30, 8, 500), (4, 1000, 35, 1 << 20), (5, 2, 35, 2000), (6, 1, 5, 200), (7, 4, 35, 1)])
def test_against_brute_force(spark, monkeypatch, seed, vocabulary, window, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    rows = random_rows(seed, vocabulary)
    found = sd.remove(table(spark, rows), window).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows, window)


def test_texts_change_and_rows_stay(spark):
    rows = random_rows(9, 50)
    found = sd.without_repeats(table(spark, rows))
    assert found.columns == ["doc_id", "text", "lang", "n_chars", "kept"]
    got = sorted(((r.doc_id, len((r.text or "").split())) for r in found.collect()), key=repr)
    assert got == sorted(((i, n - gone) for i, n, gone, _ in expected(rows, 35)), key=repr)


def test_equal_windows_have_equal_owners():
    rnd = random.Random(2)
    for vocabulary in (1, 2, 3, 20):
        texts = [" ".join(rnd.choices([f"w{i}" for i in range(vocabulary)], k=rnd.randint(0, 300))).encode() for _ in range(12)]
        words = sd.Words(texts)
        for _, low, high in sd.parse(words):
            assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
        starts, _ = words.window_starts(12)
        owner, _, low, _ = sd.owners(words, starts, 12)
        of = {}
        for p, o in zip(starts.tolist(), zip(owner.tolist(), (low - starts).tolist()), strict=True):
            assert of.setdefault(tuple(words.names[p : p + 12].tolist()), o) == o


def test_empty_table(spark):
    assert sd.remove(table(spark, [])).count() == 0
    assert sd.without_repeats(table(spark, [])).count() == 0


def shuffled_bytes(spark, job):
    """Bytes that the stages of job() write to shuffles."""

    def by_stage():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before = by_stage()
    job()
    return sum(n for stage, n in by_stage().items() if stage not in before)


def test_whole_texts_are_moved_to_be_compared_and_to_be_cut_and_no_more(spark, tmp_path):
    rnd = random.Random(8)
    fresh = lambda n: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=80)) for _ in range(n)]
    passage = fresh(40)
    rows = [(i, " ".join([*fresh(300), *passage, *fresh(60)])) for i in range(60)]
    table(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    once = shuffled_bytes(spark, lambda: docs.repartition(4, "doc_id").write.parquet(str(tmp_path / "once")))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        moved = shuffled_bytes(spark, lambda: sd.without_repeats(docs).write.parquet(str(tmp_path / "out")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert {len(r.text.split()) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {360}
    assert 1 < moved / once < 2.5


def test_columns_that_arrow_cannot_hold_are_carried(spark):
    rows = random_rows(11, 50)
    docs = table(spark, rows).selectExpr("make_ym_interval(1, int(doc_id)) own", "text", "doc_id", "make_interval(0, 0, 0, 1) span", "n_chars", "cast(doc_id as int) doc", "'x' stretches")
    found = sd.without_repeats(docs)
    assert found.schema == docs.schema
    got = sorted(((r.doc_id, len((r.text or "").split()), r.doc, r.stretches, r.days) for r in found.selectExpr("*", "cast(span as string) days").drop("span", "own").collect()), key=repr)
    assert got == sorted(((i, n - gone, i, "x", "1 days") for i, n, gone, _ in expected(rows, 35)), key=repr)
