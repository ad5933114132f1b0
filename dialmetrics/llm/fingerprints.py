"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur. For each of
``SAMPLES`` samples and each term, r and c are drawn from Gamma(2, 1) and b from
(0, 1), by a hash of term and sample alone. With weight w,

    t = floor(ln w / r + b),   ln a = ln c - r * (t - b) - r,

the sample is (term, t) of the term with the least a. Two texts agree in a sample
with a probability equal to their generalised Jaccard similarity
sum(min(w)) / sum(max(w)). A fingerprint keeps 16 bits of each sample's hash, so
likeness is the share of equal samples (unequal ones agree by chance once in
65,536).

Gamma variates come from a table of 65,536 quantiles, which a hash's 16 bits
index; texts are handled in blocks whose distinct words are hashed once.

Next documents. ``with_edits`` needs each document's successor by doc_id. Rows
are dealt into buckets by ranges of doc_id (cut points from an approximate
quantile sketch, as many as buckets), each bucket is sorted by Spark and read as
a stream that holds one row back, and the first row of each bucket is also sent
to the bucket before it. Only the keys of those first rows, one for each bucket,
are broadcast. The texts move once.

Defined results: null is the empty text; texts without words have one common
fingerprint that matches no other text's; documents are ordered by doc_id (null
first), rows that repeat an id by a hash of their text; a lone document is its
own successor; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import need

SAMPLES = 64
BLOCK_CHARS = 2_000_000     # texts whose distinct words are hashed together
BUCKET_ROWS = 1024          # rows of a bucket, on average, as far as
MAX_BUCKETS = 16384         # allows (a bucket is read as a sorted stream, so it may be large)


def gamma2_quantiles(n: int = 65536) -> np.ndarray:
    """Quantiles (i + 1/2) / n of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Fingerprints of texts; its random numbers depend on the words alone."""

    def __init__(self, samples: int = SAMPLES):
        self.r = gamma2_quantiles().astype(np.float32)
        self.log_c = np.log(gamma2_quantiles()).astype(np.float32)
        self.salt = scramble(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.samples = samples

    def variates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = scramble(hashes[:, None] ^ self.salt[None, :])
        low = np.uint64(0xFFFF)
        b = ((h >> np.uint64(32)) & low).astype(np.float32) * np.float32(2.0 ** -16)
        return self.r[h & low], self.log_c[(h >> np.uint64(16)) & low], b

    def learn(self, texts: Sequence[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Term rows and weights of each text, and the variates of all their distinct words."""
        index: dict[bytes, int] = {}
        out = []
        for text in texts:
            tf = Counter(text.split())
            rows = np.fromiter((index.setdefault(w, len(index)) for w in tf), np.int64, len(tf))
            out.append((rows, np.fromiter(tf.values(), np.int64, len(tf))))
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), np.uint64, len(index))
        self.once = np.empty((len(index), self.samples), np.float32)      # ln a where the weight is 1
        for a in range(0, len(index), 8192):
            r, log_c, b = self.variates(self.hashes[a:a + 8192])
            self.once[a:a + 8192] = log_c + r * b - r
        return out

    def sketch(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """16 bits for each sample; 0 only where there is no term."""
        if not len(rows):
            return np.zeros(self.samples, np.uint16)
        best = np.full(self.samples, np.inf, np.float32)
        term, step = np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)
        cols = np.arange(self.samples)
        # equal draws go to the smaller hash, whatever the order of the words
        order = np.argsort(self.hashes[rows], kind="stable")
        rows, weights = rows[order], weights[order]
        for a in range(0, len(rows), 32768):
            part, w = rows[a:a + 32768], weights[a:a + 32768]
            log_a = self.once[part]
            many = np.flatnonzero(w > 1)
            r, log_c, b = self.variates(self.hashes[part[many]])
            t = np.floor(np.log(w[many]).astype(np.float32)[:, None] / r + b)
            log_a[many] = log_c - r * (t - b) - r
            steps = np.zeros(len(part), np.int64)
            steps[many] = np.arange(len(many))
            at = log_a.argmin(axis=0)
            value = log_a[at, cols]
            less = value < best
            best = np.where(less, value, best)
            term = np.where(less, self.hashes[part[at]], term)
            step = np.where(less, np.where(w[at] > 1, t[steps[at], cols] if len(many) else 0, 0), step)
        code = scramble(term ^ scramble(step.astype(np.uint64) + np.uint64(1)) ^ self.salt)
        return np.maximum(code & np.uint64(0xFFFF), 1).astype(np.uint16)

    def sketches(self, texts: Sequence[bytes]) -> np.ndarray:
        known = self.learn(texts)
        return np.array([self.sketch(*x) for x in known], np.uint16).reshape(len(texts), self.samples)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def hexed(sketches: np.ndarray) -> list[str]:
    return [x.astype("<u2").tobytes().hex() for x in sketches]


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the start of the next text."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """``docs`` plus the fingerprint of each text (hex, 4 digits a sample); no shuffle."""
    need(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(text).to_pylist()]
            found = [h for a, b in spans([len(t) for t in texts]) for h in hexed(sampler.sketches(texts[a:b]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             names=[*batch.schema.names, out])

    if out in docs.columns:
        raise ValueError(f"{out!r} is a column of the table; name another")
    return docs.mapInArrow(run, docs.select("*", F.lit("").alias(out)).schema)


def spans(lengths: Sequence[int], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` characters together; a longer row is a run of its own."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


EDITS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double")


def in_order(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``bucket, doc_id, h, role, text``: rows in buckets by doc_id (role 0), and in each
    bucket also the first row of the next one (role 1; in the last bucket, of the first)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.count("doc_id").alias("known"),
                    F.count_if(F.col("doc_id").isNull()).alias("unknown")).first()
    n = min(MAX_BUCKETS, max(1, math.ceil(size["known"] / bucket_rows)))
    cuts = np.zeros(0, np.int64)
    if n > 1:
        found = base.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0]
        cuts = np.unique(np.array(found, np.int64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    # rows without an id come first, in buckets by ranges of the text's hash
    unknown = min(MAX_BUCKETS, max(1, math.ceil(size["unknown"] / bucket_rows)))
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)
    by_hash = F.least(F.floor(h / F.lit(2.0 ** 63) * unknown), F.lit(unknown - 1)).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), by_hash).otherwise(
        place(F.coalesce("doc_id", F.lit(0))) + F.lit(unknown))
    rows = base.select(bucket.alias("bucket"), "doc_id", h.alias("h"), F.lit(0).alias("role"), "text")
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("k")).orderBy("bucket").collect()
    if not firsts:
        return rows
    heads = [(firsts[i - 1]["bucket"], *r["k"]) for i, r in enumerate(firsts)]
    keys = docs.sparkSession.createDataFrame(heads, "to int, doc_id long, h long")
    same = rows["doc_id"].eqNullSafe(keys["doc_id"]) & (rows["h"] == keys["h"])
    sent = (rows.join(F.broadcast(keys), same)      # at most 2 * MAX_BUCKETS keys
            .select(keys["to"].alias("bucket"), rows["doc_id"], rows["h"], F.lit(1).alias("role"), rows["text"]))
    return rows.unionByName(sent)


def with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The contract's columns for each row of ``doc_id, text``."""
    need(docs, "doc_id", "text")
    rows = in_order(docs)
    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket", "role", "doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held: tuple | None = None       # the last row, whose successor is yet to come

        def finish(pairs: list[tuple]) -> pa.RecordBatch:
            """pairs: (doc_id, text, next text); a text is often the one before's next."""
            texts: dict[str, int] = {}
            put = lambda t: texts.setdefault(t, len(texts))
            new = [edited(t, f) for _, t, f in pairs]
            at = np.array([(put(t), put(e), put(f)) for (_, t, f), e in zip(pairs, new, strict=True)], np.int64)
            s = sampler.sketches([t.encode() for t in texts])
            name = hexed(s)
            return pa.RecordBatch.from_arrays([
                pa.array([d for d, _, _ in pairs], pa.int64()),
                pa.array([len(t) for _, t, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in new], pa.string()),
                pa.array([name[i] for i in at[:, 0]], pa.string()),
                pa.array([name[i] for i in at[:, 1]], pa.string()),
                pa.array(likeness(s[at[:, 0]], s[at[:, 1]]), pa.float64()),
                pa.array(likeness(s[at[:, 0]], s[at[:, 2]]), pa.float64())],
                names=[c.split()[0] for c in EDITS.split(", ")])

        pairs, size = [], 0
        for batch in batches:
            for bucket, doc_id, role, text in zip(batch.column("bucket").to_pylist(),
                                                  batch.column("doc_id").to_pylist(),
                                                  batch.column("role").to_pylist(),
                                                  batch.column("text"), strict=True):
                text = text.as_py()
                # a bucket's rows are followed by one row of the next bucket, sent to it
                if held is not None and (held[0] == bucket):
                    pairs.append((held[1], held[2], text))
                    size += len(text)
                held = (bucket, doc_id, text) if role == 0 else None
                if size > BLOCK_CHARS:
                    yield finish(pairs)
                    pairs, size = [], 0
        if pairs:
            yield finish(pairs)

    return sorted_rows.mapInArrow(run, EDITS)
