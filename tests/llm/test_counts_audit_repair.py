"""Operators 11 to 13: against the libraries, brute force over orders and edits, and their SQL over odd rows."""

import hashlib
import os
import random
import re
import zlib
from itertools import permutations, product

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftscope.llm import conversation_repair, filter_audit, queries, token_counts

from .test_contract_queries import CLASHES, ROWS, rows_of
from .test_corpus_operators import odd_rows

QUERIES, SQL = queries.queries(), queries.oracle_sql()


def in_duckdb(folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(SQL[name])
    return [c[0] for c in found.description], sorted(map(tuple, found.fetchall()), key=repr)


class TestTokenCounts:
    TEXTS = [t for _, t in odd_rows()] + ["a <|endoftext|> b<|startoftext|>", "can't we'll é Å ΑΣ σ", "x" * 70_000 + " " + "y z " * 40_000, " a b\u0085c", "one  two \t three\n\n4", "<s> x </s>"]

    @pytest.mark.parametrize("part", [token_counts.PART, 40])
    @pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
    def test_lengths(self, name, part, monkeypatch):
        path = public_tokenizers.path(name)
        own = token_counts.Lengths(path)
        assert own.boundary  # each of these files has safe boundaries
        monkeypatch.setattr(own, "parts", lambda content, cut=own.parts: cut(content, part))
        if name.endswith(".model"):
            library = sentencepiece.SentencePieceProcessor(model_file=path)
            want = [len(library.encode(t or "")) for t in self.TEXTS]
        else:
            library = Tokenizer.from_file(path)
            want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in self.TEXTS]
        assert own.of([(t or "").encode() for t in self.TEXTS]).tolist() == want

    def test_random_texts_in_small_parts(self, monkeypatch):
        rnd = random.Random(3)
        pick = lambda: chr(rnd.choice([rnd.randrange(32, 127), 32, 32, rnd.randrange(97, 123), rnd.randrange(97, 123), rnd.randrange(0xA0, 0x2100), 10, 0x301]))
        texts = ["".join(pick() for _ in range(rnd.randint(1, 120))) for _ in range(1500)]
        for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
            own = token_counts.Lengths(public_tokenizers.path(name))
            whole = own.of([t.encode() for t in texts]).tolist()
            monkeypatch.setattr(own, "parts", lambda content, cut=own.parts: cut(content, 12))
            assert own.of([t.encode() for t in texts]).tolist() == whole, name

    def test_parts_lose_nothing(self):
        own = token_counts.Lengths(public_tokenizers.path("word_bpe_49k.json"))
        for content in (b"", b"a", b"ab cd ef gh", b"x" * 100, b"a " * 100):
            parts = list(own.parts(content, 10))
            assert b"".join(parts) == content and all(parts[:-1])

    def test_a_file_without_safe_boundaries_is_encoded_whole(self, tmp_path):
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        settings = re.sub(r'"use_regex":\s*true', '"use_regex":false', library.to_str())
        path = tmp_path / "own.json"
        path.write_text(settings)
        own = token_counts.Lengths(str(path))
        assert own.boundary is None
        text = "word " * 300
        assert own.of([text.encode()]).tolist() == [len(Tokenizer.from_str(settings).encode(text).ids)]

    def test_balanced(self):
        sizes = [9, 1, 1, 8, 2, 2, 7, 30, 0]
        dealt = token_counts.balanced(sizes, 20)
        assert sorted(i for some in dealt for i in some) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in some) for some in dealt) == [15, 15, 30]
        assert token_counts.balanced([], 20) == []

    def test_query(self, spark, tmp_path):
        docs = spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string").withColumns({c: F.lit(7) for c in [*CLASHES, "n_tokens", "n_bytes"]})
        docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
        want = sorted(((i, len((t or "").encode()), n(t), n(t) > 2048) for i, t in ROWS), key=repr)
        assert rows_of(QUERIES["op13_token_counts"](spark, str(tmp_path))) == want
        own = token_counts.count(docs, public_tokenizers.path("word_bpe_49k.json"), ["n_tokens", "doc_id"])
        assert own.columns == ["n_tokens", "doc_id", "n_bytes", "n_tokens"] and own.count() == len(ROWS)


def audit_docs():
    rnd = random.Random(5)
    rows = [(i, t, rnd.choice(["en", "de", None, ""])) for i, t in ROWS]
    texts = ["", "SHOUT " * 120, "a $ b", " ".join(f"w{k}" for k in range(150)), " ".join(f"W{k}" for k in range(100)), "w " * 99, "É" * 10 + "A"]
    rows += [(1000 + k, rnd.choice(texts), rnd.choice(["en", "de", "xx", None])) for k in range(80)]
    rows += [(1000, texts[2], "en"), (1000, texts[2], "en"), (None, texts[2], "de"), (-5, texts[3], "en"), (-5, texts[3], None)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(1000, 1090)] + [(1001, 1, 1), (1001, 0, 0), (None, 1, 1), (5, 1, 0), (99_999, 1, 1)]
    return rows, labels


class TestFilterAudit:
    @pytest.fixture(scope="class")
    @classmethod
    def folder(cls, spark, tmp_path_factory):
        path = str(tmp_path_factory.mktemp("audit"))
        rows, labels = audit_docs()
        extra = {c: F.lit(7) for c in [*CLASHES, "A", "E", "part", "good", "n", "content"]}
        spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(extra).repartition(3).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")).write.parquet(f"{path}/labels.parquet")
        return path

    def expected(self):
        rows, labels = audit_docs()
        good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
        docs = []
        for i, text, lang in rows:
            t = text or ""
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
            smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
            fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
            docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
        out = []
        for part in {p for p, *_ in docs}:
            own = [d for d in docs if d[0] == part]
            gone = {}
            for order in map("".join, permutations("ABCDE")):
                left = own
                for step, k in enumerate(order, 1):
                    here = [d for d in left if k in d[1]]
                    left = [d for d in left if k not in d[1]]
                    gone[k] = gone.get(k, 0) + len(here)
                    redundant = sum(k in d[1] for d in own) - len(here)
                    out.append((part, order, step, len(left), len(here), redundant, sum(d[1] == {k} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)))
            out[-600:] = [(*r, gone[r[1][r[2] - 1]]) for r in out[-600:]]
        return sorted(out, key=repr)

    def test_every_order(self, spark, folder):
        found = QUERIES["op11_filter_audit"](spark, folder)
        assert rows_of(found) == self.expected()
        names, by_sql = in_duckdb(folder, "op11_filter_audit", ["documents", "labels"])
        assert names == found.columns and by_sql == self.expected()

    def test_survivors_of_all_parts(self, spark, folder):
        measured = filter_audit.measured(spark.read.parquet(f"{folder}/documents.parquet"))
        flagged = filter_audit.labelled(filter_audit.failures(measured), spark.read.parquet(f"{folder}/labels.parquet"))
        found = filter_audit.survivors(flagged).collect()
        total = {r.chosen: r.n for r in found if r.all_parts}
        assert total[0] == len(audit_docs()[0])
        for chosen in range(32):
            assert total.get(chosen, 0) == sum(r.n for r in found if not r.all_parts and r.chosen == chosen)

    def test_no_document(self, spark, tmp_path):
        spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        assert QUERIES["op11_filter_audit"](spark, str(tmp_path)).count() == 0

    def test_steps(self):
        found = filter_audit.steps("AB")
        assert found == [("AB", 1, "A", 0, 1), ("AB", 2, "B", 1, 3), ("BA", 1, "B", 0, 2), ("BA", 2, "A", 2, 3)]
        assert len(filter_audit.steps()) == 600


def cheapest(symbols):
    """Least (cost, audit) by trying every edit of every turn, with at most three inserts in each gap."""
    best = None
    gap = ["", "u", "a", "ua", "au", "uau", "aua"]
    ways = []
    for s in symbols:
        more = 3 if s.isupper() else 0
        ways.append([("D", "", 4)] + ([] if s == "-" else [("K", s.lower(), more), ("R", "u", 3 + more), ("R", "a", 3 + more)]))
    for some in product(*ways):
        for inserts in product(gap, repeat=len(symbols) + 1):
            roles = inserts[0] + "".join(role + ins for (_, role, _), ins in zip(some, inserts[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = sum(c for *_, c in some) + 3 * sum(map(len, inserts))
                audit = "I" * len(inserts[0]) + "".join(e + "I" * len(ins) for (e, *_), ins in zip(some, inserts[1:], strict=True))
                best = min(filter(None, [best, (cost, audit)]))
    return best


def conversation_rows():
    rnd = random.Random(11)
    texts = ["Yes.", "No", "", " \n", "Why?", "Because I say so!", "and then ", "x.\u0085", "tail. \t", "long " * 2000 + "."]
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(0, 14)):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.3 else ("user", "assistant")[turn % 2]
            if turn == 0 and rnd.random() < 0.3 or rnd.random() < 0.03:
                role = "system"
            rows.append((conv, turn + rnd.choice([0, 0, 0, 1]), rnd.choice([role, role, role, role, None, "tool", ""]), rnd.choice([*texts, None, f"own {conv} {turn}."])))
    rows += [(None, t, r, x) for t in (None, 3, 5) for r in ("user", "assistant") for x in ("a.", None)]
    rows += [(7, None, "user", "late."), (7, None, "user", "late."), (7, 10**12, "assistant", "far.")]
    rows += [(-1, k, ("user", "assistant")[k % 2], f"turn {k}{'.' * (k % 5 > 0)}") for k in range(700)]
    rows += [(100 + k, 0, "user", "alone") for k in range(60)]  # some of these are left without a row
    return rows


class TestConversationRepair:
    @pytest.fixture(scope="class")
    @classmethod
    def folder(cls, spark, tmp_path_factory):
        path = str(tmp_path_factory.mktemp("repair"))
        extra = {c: F.lit(7) for c in ["row_id", "place", "same", "fault", "seq", "shard", "audit", "cost", "kind"]}
        spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string").withColumns(extra).repartition(3).write.parquet(f"{path}/conversations.parquet")
        return path

    def test_layers_against_every_edit(self):
        every = list(map("".join, product("suaxUA-", repeat=3)))
        for symbols in [*map("".join, product("suaxUA-", repeat=2)), *random.Random(1).sample(every, 20)]:
            layer = conversation_repair.run_tables(symbols, True)[0]
            assert min(layer[s] for s in (conversation_repair.START, conversation_repair.ASSISTANT) if s in layer) == cheapest(symbols), symbols

    def test_runs_compose(self):
        rnd = random.Random(2)
        for _ in range(300):
            symbols = "".join(rnd.choices("suaxSUA-", k=rnd.randint(2, 40)))
            cut = rnd.randint(1, len(symbols) - 1)
            whole = conversation_repair.run_tables(symbols, True)[0]
            assert conversation_repair._joined(conversation_repair.run_tables(symbols[:cut], True)[0], conversation_repair.run_tables(symbols[cut:], False)) == whole

    def by_hand(self, rows):
        """The contract turn by turn, with one pass over four states for each conversation."""
        out = []
        for conv in sorted({r[0] for r in rows}, key=repr):
            damaged = []
            for _, turn, role, text in [r for r in rows if r[0] == conv]:
                role, text = " " if role is None else role, " " if text is None else text
                kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                damaged += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
            damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
            seen, faults = set(), []
            for _, role, text in damaged:
                lit = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
                faults.append("blank" if not lit else "duplicate" if (role, text) in seen else "truncated" if lit[-1] not in ".!?" else "")
                seen.add((role, text))
            turns = [t for t, *_ in damaged if t is not None]
            initials = [r[:1] for _, r, _ in damaged]
            states = {"": (0, "", ()), "u": (3, "I", ("user:",)), "a": (6, "II", ("user:", "assistant:"))}
            follow = {"": "su", "s": "u", "u": "a", "a": "u"}
            for (_, role, text), fault in zip(damaged, faults, strict=True):
                moves = []
                for end, (cost, audit, lines) in states.items():
                    moves.append((cost + 4, audit + "D", end, lines))
                    if fault not in ("blank", "duplicate"):
                        more = 3 * (fault == "truncated")
                        moves += [(cost + more, audit + "K", role[:1], (*lines, f"{role}:{text}"))] * (role[:1] != "" and role[:1] in follow[end])
                        moves += [(cost + more + 3, audit + "R", r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant") if r[0] in follow[end]]
                for _ in range(2):
                    moves += [(c + 3, a + "I", r[0], (*lines, f"{r}:")) for c, a, end, lines in moves for r in ("user", "assistant") if r[0] in follow[end]]
                states = {end: min((c, a, lines) for c, a, e, lines in moves if e == end) for end in {m[2] for m in moves}}
            cost, audit, lines = min(states[k] for k in ("", "a") if k in states) if damaged else (0, "", ())
            gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
        return sorted(out, key=repr)

    @pytest.mark.parametrize("segment", [conversation_repair.SEGMENT, 3])
    def test_query(self, spark, folder, segment, monkeypatch):
        monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
        found = QUERIES["op12_conversation_repair"](spark, folder)
        assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        want = self.by_hand(conversation_rows())
        assert rows_of(found) == want
        assert any(r[7] == "" for r in want) and any(len(r[7]) > 600 for r in want)

    def test_sql(self, folder):
        names, found = in_duckdb(folder, "op12_conversation_repair", ["conversations"])
        assert found == self.by_hand(conversation_rows())

    def test_edits_and_turns(self, spark):
        rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Go on."), (1, 2, "user", "And"), (1, 3, "tool", ""), (2, 0, "system", "Be kind."), (2, 1, "user", "Yes?"), (2, 2, "user", "Yes?")]
        found = conversation_repair.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
        audits = {r.conv_id: (r.cost, r.audit) for r in found.conversations.collect()}
        assert audits == {1: cheapest("auU-"), 2: cheapest("su-")}
        turns = sorted((r.conv_id, r.place, r.role, r.text) for r in found.turns.collect())
        for conv in (1, 2):
            roles = [r[2] for r in turns if r[0] == conv]
            assert [r[1] for r in turns if r[0] == conv] == list(range(len(roles)))
            assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles))
        for conv in (1, 2):
            own = sorted((r for r in found.edits.collect() if r.conv_id == conv), key=lambda r: (r.place is None, r.place))
            assert sorted(r.edit for r in own) == sorted(audits[conv][1])
            assert all((r.row_id is None) == (r.edit == "I") and (r.place is None) == (r.edit == "D") for r in own)
        assert os.path.exists(found.tables[0].written_to)

    def test_no_conversation(self, spark, tmp_path):
        spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
        assert QUERIES["op12_conversation_repair"](spark, str(tmp_path)).count() == 0
