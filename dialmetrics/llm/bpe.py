"""BPE encoding and decoding with a table of distinct words.

A byte-level BPE tokenizer first splits a text into words (pre-tokens) and then
merges within each word, so a word's ids do not depend on its place. Texts are
gathered into blocks of ``BLOCK_BYTES``:

1. each block asks for the ids of its distinct words: one row for each (block,
   bucket of words), packed and compressed;
2. a bucket meets in one place all requests for its words, encodes each distinct
   word once and answers every block in the order of its request;
3. each block is joined with its answers and sets the ids at the words' positions.

What moves is the blocks themselves (Arrow, compressed) and, in place of a row
for each occurrence, each block's distinct words and their ids. Decoding joins
ids with the table of pieces (the vocabulary, a fixed number of rows that every
task holds) and joins the bytes.

Splitting is exact: texts of code points below U+0300, whose classes no Unicode
version has changed, are split by a regular expression of the same rule, all
others by the tokenizer's own pre-tokenizer. Strings of special tokens in a text
become their ids, as the library has it. A block's answer carries a checksum of
its request; a mismatch raises (it cannot occur while the input is a table whose
scans give the same rows each time, which ``encode`` needs).

Defined results: null and empty texts give no ids and decode to the empty text;
repeated rows are encoded each; a text of any length is encoded whole (it makes
a block of its own); an empty table gives an empty table; other columns pass.
"""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (
    blocks, from_bytes, frugal, frugal_group, frugal_pair, joined, pack, to_bytes, unpack, unpack_array,
)
from .text import need

BLOCK_BYTES = 6_000_000     # text of a block
MAX_BUCKETS = 50_000        # of words; as many as blocks below that
LONG_TEXT = 2_000_000       # characters from which a text's words are not listed all at once


# ---- the tokenizer

def _classes() -> tuple[str, str, str]:
    """Letters, numbers and white space below U+0300, for a character class."""
    chars = [chr(c) for c in range(0x300)]
    def of(kind: str) -> str:
        return "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind)
    return of("L"), of("N"), r"\t\n\x0b\x0c\r \x85\xa0"


LETTER, NUMBER, SPACE = _classes()
# fixed value: the split rule of byte-level BPE vocabularies of this kind
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
                   f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile("[^\u0000-˿]")


def load(path: str) -> str:
    """The tokenizer file's content, which tasks get as text: executors need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    spec = json.loads(content)
    pre = spec["pre_tokenizer"] or {}
    if (spec["model"]["type"], pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) != (
            "BPE", "ByteLevel", True, False) or spec["normalizer"]:
        raise ValueError("a byte-level BPE tokenizer without normaliser and prefix space is needed")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in their neighbourhood are not supported")
    return content


class Splitter:
    """Words and special tokens (ids by string) of texts."""

    def __init__(self, special: dict[str, int]):
        from tokenizers.pre_tokenizers import ByteLevel

        self.own = ByteLevel(add_prefix_space=False, use_regex=True)    # the one that load() asks for
        names = sorted(special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def parts(self, text: str) -> Iterator[tuple[Iterable[str], bool]]:
        """Runs of words (and whether the run is a special token), in order."""
        for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if not part:
                continue
            if i % 2:
                yield [part], True
            elif BEYOND.search(part):
                yield [part[a:b] for _, (a, b) in self.own.pre_tokenize_str(part)], False
            elif len(part) > LONG_TEXT:
                yield (m.group() for m in WORDS.finditer(part)), False
            else:
                yield WORDS.findall(part), False


def specials(content: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.loads(content)["added_tokens"]}


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, the others for U+0100 onwards in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces(content: str) -> list[bytes]:
    """The bytes of each id."""
    spec, to = json.loads(content), byte_of()
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    out = [b""] * (max(names) + 1)
    for i, t in names.items():
        out[i] = bytes(to[c] for c in t) if all(c in to for c in t) else t.encode()
    return out


# ---- the words of a block

class Numbers(dict):
    """Numbers of words, in order of their first place."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def requests(words: Iterable[str], buckets: int) -> tuple[list[tuple[int, list[bytes]]], np.ndarray]:
    """The words (UTF-8) of each bucket that has any, in their order, and the places from which they were taken."""
    encoded = [w.encode() for w in words]
    bucket = np.fromiter(map(zlib.crc32, encoded), np.uint32, len(encoded)) % np.uint32(buckets)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first, len(order))[1:]
    return [(b, [encoded[i] for i in order[x:y].tolist()])
            for b, x, y in zip(used.tolist(), first.tolist(), ends.tolist(), strict=True)], order


# ---- the jobs

def encode(docs: DataFrame, content: str, text: str = "text", out: str = "ids",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus the ids of each text as little-endian unsigned 32-bit integers (binary)."""
    need(docs, text)
    if out in docs.columns:
        raise ValueError(f"{out!r} is a column of the table; name another")
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(1, math.ceil(total / block_bytes)))
    special = specials(content)
    loaded: dict = {}       # of a task: filled once, kept from group to group

    @frugal
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(special)
        for block, table in blocks(batches, text, block_bytes):
            seen: dict[str, None] = {}
            for t in table.column(text):
                for words, mark in splitter.parts(t.as_py() or ""):
                    if not mark:
                        seen.update(dict.fromkeys(words))
            asked, _ = requests(seen, buckets)
            del seen
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(asked), pa.int64()), pa.array([b for b, _ in asked], pa.int32()),
                pa.array([pack(ws) for _, ws in asked], pa.binary())], names=["block", "bucket", "words"])

    @frugal_group
    def answer(table: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        if not loaded:
            loaded["words"] = Tokenizer.from_str(content)
            loaded["words"].pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
            loaded["words"].no_truncation()
            loaded["words"].no_padding()
        one_word = loaded["words"]
        ids: dict[bytes, bytes] = {}
        asked = table.column("words")
        for r in asked:         # each distinct word of the bucket once
            new = [w for w in unpack(r.as_py()) if w not in ids]
            for a in range(0, len(new), 4096):
                part = new[a:a + 4096]
                found = one_word.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                ids.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in found), strict=True))
        packed, marks = [], []
        for r in asked:
            words = unpack(r.as_py())
            packed.append(pack([ids[w] for w in words]))
            marks.append(zlib.crc32(b"\xff".join(words)))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "answers": pa.array(packed, pa.binary()), "mark": pa.array(marks, pa.int64())})

    @frugal
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, text, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([to_bytes(table)], pa.binary())],
                                             names=["block", "rows"])

    @frugal_pair
    def place(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = from_bytes(block.column("rows")[0].as_py())
        splitter, number, marks = Splitter(special), Numbers(), list(special)
        places, ends = [np.zeros(0, np.int32)], []      # each text is split once: numbers of its words, special tokens below 0
        for t in rows.column(text):
            n = 0
            for run, mark in splitter.parts(t.as_py() or ""):
                places.append(np.array([-1 - marks.index(run[0])], np.int32) if mark else
                              np.fromiter(map(number.__getitem__, run), np.int32))
                n += len(places[-1])
            ends.append(n)
        asked, order = requests(number, buckets)
        number.clear()
        at = {b: i for i, b in enumerate(answers.column("bucket").to_pylist())}
        packed, crc = answers.column("answers"), answers.column("mark")
        if any(b not in at or crc[at[b]].as_py() != zlib.crc32(b"\xff".join(ws)) for b, ws in asked):
            raise RuntimeError("the input's rows differ between scans; write it as a table first")
        # ids of the words by bucket, then of the special tokens, the last one first
        items = pa.concat_arrays([*(unpack_array(packed[at[b]].as_py()) for b, _ in asked),
                                  pa.array([np.array([special[m]], "<u4").tobytes() for m in reversed(marks)], pa.binary())])
        if len(items) != len(order) + len(marks):
            raise RuntimeError("a word without ids")
        to = np.empty(len(items), np.int32)
        to[order] = np.arange(len(order))
        to[len(order):] = np.arange(len(order), len(items))
        del asked
        found = joined(items, to[np.concatenate(places)], np.cumsum(ends, dtype=np.int64))
        return rows.append_column(out, found)

    asked = docs.select(text).mapInArrow(ask, "block long, bucket int, words binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, answers binary, mark long")
    held = docs.mapInArrow(put, "block long, rows binary")
    return (held.groupBy("block").cogroup(answered.groupBy("block"))
            .applyInArrow(place, docs.select("*", F.lit(b"").alias(out)).schema))


def decode(encoded: DataFrame, content: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` plus the text of its ids; bytes that are no UTF-8 become U+FFFD, as the library has it."""
    need(encoded, ids)
    if out in encoded.columns:
        raise ValueError(f"{out!r} is a column of the table; name another")

    piece = pa.array(pieces(content), pa.binary())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):     # few rows at a time, for little memory
                batch = whole.slice(first, 256)
                numbers = [np.frombuffer(packed.as_py() or b"", "<u4") for packed in batch.column(ids)]
                found = joined(piece, np.concatenate(numbers), np.cumsum([len(n) for n in numbers]))
                try:
                    found = found.cast(pa.string())
                except pa.ArrowInvalid:     # some bytes are no UTF-8
                    found = pa.array([t.as_py().decode("utf-8", "replace") for t in found], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias(out)).schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns for ``doc_id, text``."""
    content = load(path)
    both = decode(encode(docs.select("doc_id", "text"), content), content)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
