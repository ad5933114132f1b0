"""Token counts through a digest cache.

The cache is a table of ``tokenizer, content, n_tokens``, partitioned by the
digest of the tokenizer's version (its file and the counting rule, so another
file or rule shares nothing). ``content`` is the digest of the normalised text:
what the tokenizer's own normaliser makes of it, so texts that it cannot tell
apart are one entry.

1. every document's digest is taken in the JVM and kept (checkpoint);
2. the distinct digests that the cache does not hold are the misses;
3. only the misses' texts are encoded, once each: copies are combined map-side
   before the texts move, so a text that a third of all rows hold moves once for
   each map task;
4. their counts are appended to the cache;
5. counts come back by digest. A digest's rows are dealt over ``SALTS`` salts:
   its count goes to the salts that occur, and the documents meet it there.

With a warm cache only digests move; the texts are read a second time for the
misses alone, which a join picks by digest (Spark broadcasts them by the size of
their table), and not at all where there are none.

Encoding a text. The model's pieces never hold a space mark after another
character (``load`` raises otherwise), so no merge crosses the start of a run of
spaces, and a text's count is the sum over its runs of spaces and what follows.
Each run is encoded by the library; a task remembers the counts of runs of
``MEMO_CHARS`` characters in all and then starts anew.

A lost task or driver leaves the cache as it was: appended files count only when
their job commits, and an entry that two jobs both appended counts once.

Defined results: null and empty texts have no bytes and no tokens; repeated rows
are counted each; a text of any length is counted whole; an empty table gives an
empty table and appends nothing; extra columns, clashing names among them, are
not read by ``digest`` and pass through ``with_counts``, where a column that
bears a result's name is replaced.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .text import need, spare, utf8

LIMIT = 4096
SALTS = 64
MEMO_CHARS = 4_000_000      # of the runs whose counts a task remembers
LONG_TEXT = 1_000_000       # characters from which a text's runs are not listed all at once
PART_RUNS = 100_000         # but so many at a time
SLICE_ROWS = 64
RULE = "spaces as marks; dummy prefix; pieces of whole text; rule 1"
MARK = "▁"             # what the model writes for a space
RUNS = re.compile(" *[^ ]+| +")
CACHE = "tokenizer string, content binary, n_tokens long"


# ---- the tokenizer

def load(path: str) -> bytes:
    """The model file, which tasks get as bytes: executors need no copy of the file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as f:
        model = f.read()
    spec = proto.ModelProto()
    spec.ParseFromString(model)
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("a model without character map, with a dummy prefix and with all white space kept is needed")
    if spec.trainer_spec.treat_whitespace_as_suffix or any(p.type == p.USER_DEFINED for p in spec.pieces):
        raise ValueError("space marks at word ends and user-defined pieces are not supported")
    if any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in spec.pieces):
        raise ValueError("a piece holds a space mark after another character; runs cannot be counted by themselves")
    return model


def version(model: bytes) -> str:
    """The digest of the tokenizer and of the rule by which texts are counted."""
    return hashlib.sha256(hashlib.sha256(model).digest() + RULE.encode()).hexdigest()


def normalised(text: str = "text") -> Column:
    """The text as the tokenizer's normaliser leaves it: the mark and the space are one character to it."""
    return F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(" "))


class Counter:
    """Token counts of texts, run by run."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        spec.normalizer_spec.add_dummy_prefix = False
        self._encode = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self._memo: dict[str, int] = {}     # by run without its first space
        self._held = 0

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The runs of a text, each without its first space, some at a time.

        The first run's space is the dummy prefix. Single spaces split a text at once.
        """
        if len(text) <= LONG_TEXT and text[0] != " " and "  " not in text:
            yield text.split(" ")
            return
        found = (m.group()[1:] for m in RUNS.finditer(" " + text))
        if len(text) <= LONG_TEXT:
            yield list(found)
        while runs := list(islice(found, PART_RUNS)):
            yield runs

    def _learn(self, runs: Iterable[str]) -> None:
        new = list({r for r in runs if r not in self._memo})
        self._memo.update(zip(new, map(len, self._encode.encode([" " + r for r in new], num_threads=1)), strict=True))
        self._held += sum(map(len, new))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of normalised texts."""
        memo, out = self._memo, []
        listed = [next(self._parts(t), []) if 0 < len(t) <= LONG_TEXT else [] for t in texts]
        self._learn(r for runs in listed for r in runs)
        for t, runs in zip(texts, listed, strict=True):
            n = sum(map(memo.__getitem__, runs))
            for part in self._parts(t) if len(t) > LONG_TEXT else ():
                self._learn(part)
                n += sum(map(memo.__getitem__, part))
            out.append(n)
        if self._held > MEMO_CHARS:
            memo.clear()
            self._held = 0
        return out


# ---- the cache

def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """``content, n_tokens`` of one tokenizer version, each digest once; no rows where there is no cache yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, misses: DataFrame | None, model: bytes, text: str = "text") -> DataFrame:
    """``content, n_tokens`` of each distinct text of ``docs`` (that is a miss, where misses are given)."""
    rows = docs.select(normalised(text).alias("t")).select(F.unhex(F.sha2("t", 256)).alias("content"), "t")
    if misses is not None:
        rows = rows.join(misses, "content", "left_semi")
    one = rows.groupBy("content").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(model)
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                counts = counter.counts(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(counts, pa.int64())],
                                                 names=["content", "n_tokens"])

    return one.mapInArrow(run, "content binary, n_tokens long")


def fill(docs: DataFrame, digests: DataFrame, cache: str, model: bytes, text: str = "text") -> None:
    """Append the counts of all digests (column ``content``) that the cache lacks."""
    spark, tokenizer = docs.sparkSession, version(model)
    held = read_cache(spark, cache, tokenizer)
    misses = digests.select("content").distinct()
    cold = held.isEmpty()
    if not cold:
        misses = misses.join(held, "content", "left_anti").checkpoint()
    if misses.isEmpty():
        return
    found = encode_misses(docs, None if cold else misses, model, text)
    (found.select(F.lit(tokenizer).alias("tokenizer"), "content", "n_tokens")
     .write.mode("append").partitionBy("tokenizer").parquet(cache))


def with_counts(docs: DataFrame, model: bytes, cache: str, text: str = "text", out: str = "n_tokens",
                keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus each text's tokens, through the cache in folder ``cache``."""
    need(docs, text, *(keep or []))
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out.lower()])
    digest, salt = spare(docs, "content"), spare(docs, "_salt")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    keyed = docs.select(*names, F.unhex(F.sha2(normalised(text), 256)).alias(digest),
                        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias(salt)).checkpoint()
    fill(docs, keyed.select(F.col(digest).alias("content")), cache, model, text)
    places = keyed.select(F.col(digest).alias("content"), salt).distinct()
    counts = (read_cache(spark, cache, version(model)).join(places, "content")
              .select(F.col("content").alias(digest), salt, F.col("n_tokens").alias(out)))
    return keyed.join(counts, [digest, salt]).select(*names, out)


def digest(docs: DataFrame, path: str, cache: str | None = None) -> DataFrame:
    """The contract's columns for ``doc_id, text``; without ``cache``, a new one in the shared checkpoint folder."""
    cache = cache or f"{ensure_checkpoint_dir(docs.sparkSession)}/token-counts-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text", F.octet_length(utf8("text")).cast("long").alias("n_bytes"))
    counted = with_counts(rows, load(path), cache, keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
