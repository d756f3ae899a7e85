"""Byte-level BPE: merges compiled into a lazily determinised transducer, and a streaming UTF-8 decoder.

Encoding. In a rank file the encoding of a byte string is the one sequence of tokens that spells it and in
which each two neighbours are stable: merging their joint bytes gives the same two tokens back. A machine that
guesses token boundaries and checks each neighbour pair against the merges is therefore a nondeterministic
transducer for the encoding. `Transducer` determinises it lazily: a state is the set of live guesses (the last
token, the bytes of the token under way, the tokens not yet emitted), made when a text first reaches it
and kept by byte afterwards. Tokens that all live guesses agree on are emitted at once, so what is held back is
the machine's lookahead. A guess dies when its bytes leave the trie of tokens or its pair isn't stable, so few
live at a time. At the end of a piece the guess that stands on a token boundary gives the rest. A piece that is
a token itself is that token, as in the tiktoken library. The lookahead is bounded for any rank file in which each
token is made of merges of lower rank: a border of stable neighbours is settled by the bytes of the tokens beside it.
`Transducer.lookahead` tells how many tokens were held back at most; over the supplied ranks it stays below
LOOKAHEAD in the tests.

Texts are split by the vocabulary's pattern first, as its users do. The library's classes of characters are another
Unicode version's than those of Python's engines, so `split_rule` asks the library once, on the driver, which
characters each class of the pattern has; texts with a character on which the engines differ are split by a pattern
that spells the difference out. A pattern with inline flags is refused. Only for WORDWISE texts are cut into words
first; any other pattern is applied to whole texts. The ids of pieces and words met before are kept, the lately met
ones, in a task's process; others go through the machine again.

Decoding. `Utf8Decoder` reads tokens one by one. Its states are those of the UTF-8 automaton (Unicode table
3-7); for each state it keeps, by token, the next state and the text that the token completes, so a character
that is split over tokens is held back until its last byte. Bytes that no continuation makes valid give U+FFFD.

Null counts as empty and encodes to no id; rows keep their order and repeat freely; an empty table gives an
empty result. Texts are taken whole, in blocks of bounded bytes; bytes that aren't UTF-8 count as U+FFFD. Columns
besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Words whose ids a process keeps, twice.
KEPT_WORDS = 500_000
#: Deterministic states that a process keeps before it starts anew.
KEPT_STATES = 250_000
#: Tokens held back at most, as tested.
LOOKAHEAD = 8

# Fixed value: the one pattern whose pieces may be found word by word. In it only `\\s+` joins white space with
# anything, and only with more white space, and a space goes before what follows it. So where no two white-space
# characters stand together, every space and line feed begins a piece, and pieces begin alike wherever the word stands.
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Brackets and classes of a pattern; other escapes are read past.
_CLASS = re.compile(r"(\[\^?\]?(?:\\.|[^\]\\])*\]|\\[pP](?:\{[^}]*\}|.)|\\[sSdDwW])|\\.", re.DOTALL)


def _spelled(characters: Iterable[str]) -> str:
    """Characters as the inside of a bracket, by ranges; empty of none."""
    points, out = sorted(map(ord, characters)), []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def _every_character() -> str:
    return "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))


@lru_cache(maxsize=64)
def library_class(item: str) -> frozenset[str]:
    """The characters that a class has in the library's engine: what it matches is encoded, byte by byte, and nothing else."""
    import tiktoken

    one = tiktoken.Encoding("class", pat_str=item, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return frozenset(bytes(one.encode_ordinary(_every_character())).decode())


@lru_cache(maxsize=8)
def split_rule(pattern: str) -> tuple[str, str, str]:
    """The pattern, a bracket of the characters on which the engines differ ("" of none), and the pattern for texts with these."""
    if re.search(r"(?<!\\)\(\?[a-zA-Z-]", pattern):
        raise ValueError("a pattern with inline flags can't be held against the library's classes")
    every, odd = _every_character(), set()

    def told(found: re.Match) -> str:
        item = found[1]
        if item is None:
            return found[0]
        theirs, ours = library_class(item), frozenset(regex.findall(item, every))
        odd.update(theirs ^ ours)
        more, fewer = _spelled(theirs - ours), _spelled(ours - theirs)
        own = f"(?![{fewer}]){item}" if fewer else item
        return f"(?:{own}|[{more}])" if more else f"(?:{own})" if fewer else item

    exact = _CLASS.sub(told, pattern)
    if pattern == WORDWISE:  # words are told apart by Python's own classes
        odd.update(library_class(r"\p{L}") ^ frozenset(filter(str.isalpha, every)))
        odd.update(library_class(r"\s").difference(filter(str.isspace, every)))
    return pattern, f"[{_spelled(odd)}]" if odd else "", exact


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Ranks of tokens, compiled on demand into edges from state to state by byte.

    A guess is (last token or -1, trie node of the bytes under way, tokens held back); a state is the tuple of
    live guesses, in the order in which they arose.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.children[node].setdefault(byte, len(self.ends))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append(-1)
            self.ends[node] = rank
        self.stable: dict[int, bool] = {}
        #: Tokens held back at most so far.
        self.lookahead = 0
        self.spines: dict[int, tuple[list[bytes], list[bytes], bool, bool]] = {}
        self._reset()

    def _reset(self) -> None:
        if len(self.stable) > 2 * KEPT_STATES:
            self.stable.clear()
        self.start = ((-1, 0, ()),)
        self.next: dict[tuple, dict[int, tuple[dict, tuple[int, ...]]]] = {}
        #: edges of the start; each table of edges also has its state, under -1
        self.root = self._table(self.start)

    def _table(self, state: tuple) -> dict:
        table = self.next.get(state)
        if table is None:
            table = self.next[state] = {-1: state}
        return table

    def merges(self, piece: bytes) -> Iterator[list[bytes]]:
        """The parts after each merge: lowest rank first, leftmost of equals. For compiling only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        yield parts
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield parts

    def _spine(self, token: int) -> tuple[list[bytes], list[bytes], bool, bool]:
        """How a token's first and last part grow as it is merged; whether it ends as one part, and in rank order."""
        found = self.spines.get(token)
        if found is None:
            first, last, parts = [], [], []
            for parts in self.merges(self.token[token]):
                if not first or first[-1] != parts[0]:
                    first.append(parts[0])
                if not last or last[-1] != parts[-1]:
                    last.append(parts[-1])
            grows = all(self.ranks[x] < self.ranks[y] for side in (first, last) for x, y in zip(side[1:], side[2:], strict=False))
            found = self.spines[token] = (first, last, len(parts) == 1, grows)
        return found

    def _pair(self, a: int, b: int) -> bool:
        """Whether merging the joint bytes of a and b gives a and b: no merge crosses their border."""
        known = self.stable.get(a << 32 | b)
        if known is None:
            (_, left, _, grows), (right, _, whole, too) = self._spine(a), self._spine(b)
            if not whole:
                known = False  # no merges make b
            elif grows and too:
                known = self._walk_border(left, right)
            else:
                *_, parts = self.merges(self.token[a] + self.token[b])
                known = parts == [self.token[a], self.token[b]]
            self.stable[a << 32 | b] = known
        return known

    def _walk_border(self, left: list[bytes], right: list[bytes]) -> bool:
        """Grow both sides of the border in order of rank; a crossing merge that comes first breaks the pair."""
        ranks, never = self.ranks, 1 << 60
        i = j = 0
        while True:
            cross = ranks.get(left[i] + right[j], never)
            grow_left = ranks[left[i + 1]] if i + 1 < len(left) else never
            grow_right = ranks[right[j + 1]] if j + 1 < len(right) else never
            if cross < grow_left and cross <= grow_right and cross < never:
                return False  # of equals the leftmost merge comes first
            if grow_left == never and grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _step(self, state: tuple, byte: int) -> tuple[dict, tuple[int, ...]]:
        """Determinise one step: advance all guesses, close the one that can end here, emit what all agree on.

        The bytes so far have one encoding, so at most one guess stands on a boundary.
        """
        children, ends, stable, found, closed = self.children, self.ends, self.stable, [], False
        for last, node, held in state:
            node = children[node].get(byte)
            if node is None:
                continue
            if children[node]:
                found.append((last, node, held))
            token = -1 if closed else ends[node]
            if token < 0:
                continue
            if last < 0:
                closed = self._spine(token)[2]
            else:
                known = stable.get(last << 32 | token)
                closed = self._pair(last, token) if known is None else known
            if closed:
                found.append((token, 0, (*held, token)))
        if not found:
            return self._table(()), ()
        first = found[0][2]
        n = len(first)
        for _, _, held in found[1:]:
            if not n:
                break
            n = min(n, len(held))
            while first[:n] != held[:n]:
                n -= 1
        self.lookahead = max(self.lookahead, *(len(held) - n for _, _, held in found))
        return self._table(tuple((last, node, held[n:]) for last, node, held in found) if n else tuple(found)), first[:n]

    def encode(self, piece: bytes) -> list[int]:
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        if len(self.next) > KEPT_STATES:
            self._reset()
        edges, out = self.root, []
        for byte in piece:
            if byte not in edges:
                edges[byte] = self._step(edges[-1], byte)
            edges, emitted = edges[byte]
            if emitted:
                out += emitted
        ends = [held for last, node, held in edges[-1] if not node]
        if len(ends) != 1:
            raise ValueError(f"{len(ends)} encodings of {piece!r}: the ranks lack a byte, or aren't those of a BPE")
        out += ends[0]
        return out


#: UTF-8 by state: (low, high, next state) of allowed bytes; state 0 is between characters.
UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0xA0, 0xBF, 1)],
    3: [(0x80, 0xBF, 1)],
    4: [(0x80, 0x9F, 1)],
    5: [(0x90, 0xBF, 3)],
    6: [(0x80, 0xBF, 3)],
    7: [(0x80, 0x8F, 3)],
}


class Utf8Decoder:
    """Tokens to text, as they come. feed() gives the text that is complete; finish() ends a stream."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        #: (state, bytes held back) -> token -> ((state, bytes held back), text completed)
        self.edges: dict[tuple[int, bytes], dict[int, tuple[tuple[int, bytes], str]]] = {(0, b""): {}}

    @staticmethod
    def _walk(at: tuple[int, bytes], data: bytes) -> tuple[tuple[int, bytes], str]:
        state, held = at
        held, out = bytearray(held), []
        for byte in data:
            while True:
                goes = next((to for low, high, to in UTF8[state] if low <= byte <= high), None)
                if goes is not None:
                    held.append(byte)
                    state = goes
                    if state == 0:
                        out.append(held.decode())
                        held.clear()
                    break
                out.append("�")
                held.clear()
                if state == 0:
                    break
                state = 0  # the byte may begin a character
        return (state, bytes(held)), "".join(out)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        at = (0, b"")
        edges = self.edges[at]
        for i in ids:
            edge = edges.get(i)
            if edge is None:
                edge = edges[i] = self._walk(at, self.token[i])
                self.edges.setdefault(edge[0], {})
            if edge[0] != at:
                at = edge[0]
                edges = self.edges[at]
            yield edge[1]
        if at[0]:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


#: A comma or full stop between a letter and white space, and what is put before it.
_MARK, _APART = re.compile(r"[.,](?<=[A-Za-z].)(?=[ \n]|\Z)"), "\x01"


class Codec:
    """Encoder of one vocabulary, with the ids of words that it has met.

    By WORDWISE a text without two white-space characters together is the row of its words, each with the space or
    line feed before it. A word of letters alone is one piece, and a comma or full stop after letters is one by itself.
    """

    def __init__(self, path: str, rule: tuple[str, str, str]):
        pattern, odd, exact = rule
        self.plain, self.exact = regex.compile(pattern).findall, regex.compile(exact).findall
        self.odd = re.compile(odd).search if odd else lambda text: None
        self.spaces = re.compile(r"\s\s").search
        self.transducer = Transducer(read_ranks(path))
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.wordwise = pattern == WORDWISE

    def _piece(self, piece: str) -> bytes:
        found = self.transducer.encode(piece.encode())
        return struct.pack(f"<{len(found)}I", *found)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.plain(text)))

    def _whole(self, text: str) -> bytes:
        pieces = self.plain if text.isascii() or not self.odd(text) else self.exact
        return b"".join(map(self._piece, pieces(text)))

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(f" {word}")
        if word[:1] == _APART:
            return self._piece(word[1:])
        return self._pieces(word if word[:1] == "\n" else f" {word}")

    def _words(self, text: str) -> list[str] | None:
        """None if the text must be taken whole."""
        if not self.wordwise or self.spaces(text) or _APART in text or not text.isascii() and self.odd(text):
            return None
        return _MARK.sub(f" {_APART}\\g<0>", text).replace("\n", " \n").split(" ")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.newer) > KEPT_WORDS:  # words met lately outlive this
            self.older, self.newer = self.newer, {}
        known, get, old = self.newer, self.newer.get, self.older.get
        split = [self._words(x) for x in texts]
        found = [None if words is None else list(map(get, words)) for words in split]
        gaps = [() if ids is None else list(compress(range(1, len(ids)), map(not_, ids[1:]))) for ids in found]
        for word in {words[i] for words, at in zip(split, gaps, strict=True) for i in at}:
            ids = old(word)
            known[word] = self._word(word) if ids is None else ids
        out = []
        for text, words, ids, at in zip(texts, split, found, gaps, strict=True):
            if words is None:
                out.append(self._whole(text))
                continue
            for i in at:
                ids[i] = known[words[i]]
            ids[0] = self._pieces(words[0])  # nothing stands before it
            out.append(b"".join(ids))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def codec(path: str, rule: tuple[str, str, str]) -> Codec:
    """One a process, so that states and pieces last from task to task."""
    return Codec(path, rule)


@lru_cache(maxsize=2)
def decoder(path: str) -> Utf8Decoder:
    return Utf8Decoder({rank: token for token, rank in read_ranks(path).items()})


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of each row's text.

    decoded: also text, decoded from the ids in the same task, so that a core needs one process and not two.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), *([("text", pa.string())] if decoded else [])])
    rule = split_rule(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, rule)
        back = decoder(path) if decoded else None
        for block in common.blocks(batches, most=4 << 20):
            ids = own.encode_all(common.texts(block.column("text")))
            out = {"doc_id": block.column("doc_id").cast(pa.int64()), "ids": ids}
            if back:
                out["text"] = [back.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield from common.emit(out, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text, decoded from the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for block in common.blocks(batches, "ids", 8 << 20):
            texts = [own.decode(np.frombuffer(x, "<u4").tolist()) for x in common.encoded(block.column("ids"))]
            yield from common.emit({"doc_id": block.column("doc_id"), "ids": block.column("ids"), "text": texts}, schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
