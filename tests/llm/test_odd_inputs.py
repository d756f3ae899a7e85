"""What the operators do with characters, JSON, vocabularies, names and sizes that few tables have."""

import base64
import json
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftscope.llm import byte_bpe, chat, language_id, token_files

from .test_corpus_operators import PATH, PATTERN, odd_rows, table
from .test_more_operators import WORDS, TestToolCalls

CLASHES = ["__key", "__id", "__text", "__lang", "__score", "__hash", "__doc", "__kept", "c0", "c1", "text0", "found", "sure", "best", "odds", "key", "r", "t"]


class TestBytePairs:
    @pytest.fixture(scope="class")
    @classmethod
    def library(cls):
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})

    @pytest.fixture(scope="class")
    @classmethod
    def own(cls):
        return byte_bpe.codec(PATH, byte_bpe.split_rule(PATTERN))

    def ids(self, own, text):
        return np.frombuffer(own.encode(text), "<u4").tolist()

    def test_every_character_between_letters(self, own, library):
        every = byte_bpe._every_character()
        for i in range(0, len(every), 50):
            text = " x".join(f"a{c}b" for c in every[i : i + 50])
            assert self.ids(own, text) == library.encode_ordinary(text)

    def test_characters_on_which_the_engines_differ(self, own, library):
        odd = [c for c in map(chr, range(0x20, 0x33480)) if own.odd(c)]
        assert len(odd) > 20
        for c in odd:
            for text in (f"{c}뒽", f"{c}'d", f" {c}'ll x", f"a{c}{c}1", f"{c} {c}\n{c}  {c}"):
                assert self.ids(own, text) == library.encode_ordinary(text)

    def test_random_characters(self, own, library):
        rnd = random.Random(9)
        pick = lambda: chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x32000), rnd.randrange(0xAC00, 0xD7A4), rnd.randrange(32, 127), 32, 10, 39]))
        for _ in range(20_000):
            text = "".join(pick() for _ in range(rnd.randint(0, 14)))
            assert self.ids(own, text) == library.encode_ordinary(text)
        assert own.transducer.lookahead <= byte_bpe.LOOKAHEAD

    def test_other_patterns_are_applied_to_whole_texts(self, tmp_path):
        ranks = {bytes([i]): i for i in range(256)} | {b".\n": 256, b"ab": 257}
        path = tmp_path / "own.tiktoken"
        path.write_text("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items()))
        for pattern in (r"[.!?]\n?|[^.!?\n]+|\n", r" ?\p{L}+[.]?\n?|\s+|.", r"\p{Lu}?\p{Ll}+|\S|\s"):
            library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            own = byte_bpe.Codec(str(path), byte_bpe.split_rule(pattern))
            for text in ("a.\nb", "ab. ab\nab.", "Ab aB.\n\n", "", "՘.\n뒽"):
                assert self.ids(own, text) == library.encode_ordinary(text), pattern
        with pytest.raises(ValueError):
            byte_bpe.split_rule(r"(?i:'s)|\p{L}+")

    def test_no_utf8(self, spark):
        docs = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text union all select 2L, 'ok'")
        found = {r.doc_id: r.text for r in byte_bpe.encode(docs, PATH, PATTERN, decoded=True).collect()}
        assert found == {1: "a�b", 2: "ok"}


class TestVocabularies:
    def file(self, tmp_path, **changes):
        with open(WORDS, encoding="utf-8") as source:
            settings = json.load(source) | changes
        path = tmp_path / "own.json"
        path.write_text(json.dumps(settings), encoding="utf-8")
        return str(path)

    @pytest.mark.parametrize(
        "changes",
        [
            {"normalizer": None},
            {"normalizer": {"type": "Lowercase"}},
            {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
            {"added_tokens": [{"id": 49406, "content": "and so", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]},
            {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
        ],
    )
    def test_what_is_not_wordwise_goes_through_the_library(self, tmp_path, changes):
        path = self.file(tmp_path, **changes)
        own, library = token_files.WordEncoder(path), Tokenizer.from_file(path)
        library.no_truncation()
        texts = ["One two. THREE", "and so on", "a\nb  c", "", "É é 1"]
        assert not own.wordwise and token_files.WordEncoder(WORDS).wordwise
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode([t.encode() for t in texts])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]

    def test_some_documents_are_read_by_select(self, spark, monkeypatch):
        monkeypatch.setattr(token_files, "SEGMENT", 3000)
        folder = token_files.write_ids(table(spark, odd_rows()), WORDS, 1)
        every = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read_ids(spark, folder).collect())
        some = [0, 5, 100, 69, 12_345]
        found = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read_some(spark, folder, spark.createDataFrame([(i,) for i in some], "doc_id long")).collect())
        assert found == Counter({k: n for k, n in every.items() if k[0] in some}) and sum(found.values()) == 5


class TestJson:
    def one(self, spark, arguments, schemas=None):
        calls = spark.createDataFrame([(1, f"c{i}", None, "f", a, 1) for i, a in enumerate(arguments)], TestToolCalls.CALLS)
        results = spark.createDataFrame([], TestToolCalls.RESULTS)
        return [r for r in sorted(chat.link(calls, results, schemas or {"f": {}}).collect(), key=lambda r: int(r.call_id[1:]))]

    def test_deep_nesting(self, spark):
        nested = lambda n: "[" * n + "]" * n
        inside = json.dumps("[" * 5000)
        found = self.one(spark, [nested(chat.NESTED), nested(chat.NESTED + 1), nested(100_000), "[" * 100_000, inside, '{"a":' * 3000 + "1" + "}" * 3000])
        assert [r.problems for r in found] == [[], *[["$: nested too deep"]] * 3, [], ["$: nested too deep"]]
        assert json.loads(found[2].json)["arguments"] == nested(100_000)

    def test_lone_surrogates(self, spark):
        found = self.one(spark, ['{"\\ud800": "\\udc00x", "\\ud83d\\ude00": 1}'], {"f": {"additionalProperties": False}})[0]
        assert found.json.startswith('{"arguments":{"\\ud800":"\\udc00x","😀":1},')
        assert found.problems == ["$.\\ud800: not known", "$.😀: not known"] and json.loads(found.json)["arguments"] == {"\ud800": "\udc00x", "😀": 1}

    def test_long_numbers(self, spark):
        digits = "7" * 20_000
        found = self.one(spark, [digits, f'{{"a": -{digits}}}', "1e400", "-0", "-0.0", "1e2", "12345678901234567890.0"])
        assert found[0].json == f'{{"arguments":{digits},"call_id":"c0","name":"f","state":"pending","valid":true}}'
        assert f'"a":-{digits}' in found[1].json
        assert [r.json.split(",")[0] for r in found[2:]] == ['{"arguments":null', '{"arguments":0', '{"arguments":0', '{"arguments":100', '{"arguments":12345678901234567168']

    def test_true_is_not_one(self):
        assert chat.errors(True, {"enum": [1]}) and not chat.errors(1, {"enum": [1]}) and not chat.errors(1.0, {"enum": [1]})

    def test_very_long_arguments_and_hash_joins(self, spark, capsys):
        long = json.dumps({"x": "y" * 3_000_000})
        found = self.one(spark, [long, long])
        assert [len(r.json) > 3_000_000 and r.valid for r in found] == [True, True]
        rows = spark.range(5000).selectExpr("id conv_id", "string(id) call_id")
        calls = rows.selectExpr("conv_id", "call_id", "string(null) parent_id", "'f' name", "'1' arguments")
        chat.link(calls, rows.selectExpr("conv_id", "call_id", "'r' content"), {"f": {}}).explain()
        plan = capsys.readouterr().out
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


class TestLongTexts:
    def test_pieces_invent_no_ngrams(self):
        rnd = random.Random(3)
        texts = ["".join(rnd.choices("ab \nß", k=rnd.choice([0, 1, 2, 5, 40]))) for _ in range(60)]
        count = lambda piece: Counter((b, t) for bucket, text in language_id.ngram_hits(texts, piece) for b, t in zip(bucket.tolist(), text.tolist(), strict=True))
        assert all(count(piece) == count(1 << 18) for piece in (1, 2, 3, 7, 64))
        alone = Counter((b, i) for i, x in enumerate(texts) for bucket, _ in language_id.ngram_hits([x]) for b in bucket.tolist())
        assert alone == count(1 << 18)
        assert sum(len(b) for b, _ in language_id.ngram_hits(["x" * 1_800_000])) == 3 * 1_800_002 - 3

    def test_long_ties_and_repeats(self, spark):
        docs = spark.createDataFrame([(1, "the and " * 200_000, "en"), (2, "und die", "de"), (2, "und die", "de"), (3, "the and", "en"), (4, "qq", "aa"), (5, "qq", "bb"), (6, "qq", None)], "doc_id long, text string, lang string")
        found = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.predict(docs, language_id.fit(docs), ["doc_id"]).collect()}
        assert len(found) == 6  # of repeated rows one result
        assert {(i, x) for i, x, _ in found} == {(1, "en"), (2, "de"), (3, "en"), (4, "aa"), (5, "aa"), (6, "aa")}


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, stage):
    rows = [*odd_rows(), (800, "shared " + " ".join(f"w{k}" for k in range(60))), (801, " ".join(f"w{k}" for k in range(60)) + " other")]
    plain = table(spark, rows)
    clashing = plain.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
    run = dict(corpus_pipeline.STAGES)[stage]
    found = run(spark, clashing, "")
    assert found.columns[: len(clashing.columns)] == clashing.columns
    own = plain.columns
    assert Counter(map(tuple, found.select(own).collect())) == Counter(map(tuple, run(spark, plain, "").select(own).collect()))
    for r in found.collect():
        assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for c in CLASHES)
