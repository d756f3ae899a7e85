"""Token counts: batch encoding in Arrow functions that give lengths only.

`count` reads texts in blocks of bounded bytes, cuts long ones at safe boundaries into parts, deals the parts to batches
of nearly equal bytes and sums the parts' lengths; ids never leave the function. A boundary is safe if the tokens of both
sides are those of the whole:

- `.json` files found wordwise (`token_files.is_wordwise`): any ASCII white space; words are looked up once a process.
- other `.json` files that split as byte-level BPE does, without a normaliser: between an ASCII letter and a space that
  a letter follows; the space goes with what comes after.
- `.model` files: the same place, if no piece of the vocabulary goes on over a space and a probe agrees; the space is
  left out, as the library puts one before each text.
- any other file: none; its texts are encoded whole.

Null texts count as empty; bytes that aren't UTF-8 as U+FFFD in tokens, as they are in n_bytes. Repeated rows are each
counted; an empty table gives an empty result. Other columns come through as asked for, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common, token_files

#: Bytes of text that a task takes up at once, of a part of a long text, and of a batch that the library gets at once.
BLOCK, PART, BATCH = 4 << 20, 1 << 16, 1 << 18
_SPACE = re.compile(rb"[ \t-\r]")
_BETWEEN_WORDS = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


class Lengths:
    """Numbers of tokens of texts, as the library for a file gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words = self.boundary = None
        self.skipped = 0  # bytes of a boundary that no side keeps
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            if self._pieces_end_at_spaces():
                self.boundary, self.skipped = _BETWEEN_WORDS, 1
            self.encode = lambda texts: [len(x) for x in self.pieces.encode(texts, num_threads=1)]
            return
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        if token_files.is_wordwise(settings):
            self.words, self.boundary = token_files.encoder(path), _SPACE
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if self._splits_before_spaces(settings):
            self.boundary = _BETWEEN_WORDS
        self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _splits_before_spaces(settings: dict) -> bool:
        splitter = settings.get("pre_tokenizer") or {}
        added = all(not t["lstrip"] and not t["rstrip"] and " " not in t["content"] for t in settings.get("added_tokens", []))
        return bool(added and not settings.get("normalizer") and splitter.get("type") == "ByteLevel" and splitter.get("use_regex"))

    def _pieces_end_at_spaces(self) -> bool:
        own = self.pieces
        crossing = any("▁" in own.id_to_piece(i).lstrip("▁") for i in range(own.get_piece_size()))
        return not crossing and own.encode("a b") == [*own.encode("a"), *own.encode("b")]

    def parts(self, content: bytes, most: int = PART) -> Iterator[bytes]:
        """A text cut about each `most` bytes: at the last safe boundary of the KB before, or at the next one beyond."""
        start = 0
        while self.boundary and len(content) - start > most:
            end = start + most
            near = list(self.boundary.finditer(content, max(start + 1, end - 1024), end))
            found = near[-1] if near else self.boundary.search(content, end)
            if not found:
                break
            yield content[start : found.start()]
            start = found.start() + self.skipped
        yield content[start:]

    def of(self, contents: list[bytes]) -> np.ndarray:
        """The number of tokens of each text."""
        owner, parts = [], []
        for i, content in enumerate(contents):
            for part in self.parts(content):
                owner.append(i)
                parts.append(part)
        counts = np.zeros(len(contents), np.int64)
        for some in balanced([len(x) for x in parts], BATCH):
            if self.words:
                found = [len(x) // self.words.width for x in self.words.encode([parts[k] for k in some])]
            else:
                found = self.encode([parts[k].decode("utf-8", "replace") for k in some])
            np.add.at(counts, [owner[k] for k in some], found)
        return counts


def balanced(sizes: list[int], most: int) -> list[list[int]]:
    """Places dealt to ceil(sum / most) batches of nearly equal bytes: each next longest one to the lightest batch."""
    heap = [(0, k) for k in range(max(1, -(-sum(sizes) // most)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size, k = heap[0]
        out[k].append(i)
        heapq.heapreplace(heap, (size + sizes[i], k))
    return [x for x in out if x]


@lru_cache(maxsize=1)
def lengths(path: str) -> Lengths:
    """One a process."""
    return Lengths(path)


def count(docs: DataFrame, tokenizer: str, columns: list[str]) -> DataFrame:
    """These columns of every row of docs, n_bytes (UTF-8) and n_tokens of its text."""
    held, back = common.aside(docs, columns, F.col("text").alias("text"))
    fields = [*held.columns[:-1], "n_bytes", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(tokenizer)
        for block in common.blocks(batches, most=BLOCK):
            contents = common.encoded(block.column("text"))
            table = block.drop_columns(["text"])
            table = table.append_column("n_bytes", pa.array(map(len, contents), pa.int64())).append_column("n_tokens", pa.array(own.of(contents)))
            yield from table.select(fields).to_batches(max_chunksize=20_000)

    schema = StructType([*held.schema.fields[:-1], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return held.mapInArrow(run, schema).select(*back, "n_bytes", "n_tokens")
