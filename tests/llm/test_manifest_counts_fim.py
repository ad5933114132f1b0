"""Merkle manifest, token counts and fill-in-middle against plain statements, with the odd rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from compare import compare_one, duck
from conftest import SF001, SF01
from dialmetrics.llm import fim, manifest, queries, token_counts

ODD = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- both queries that SQL can state

@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_its_oracle(spark, name):
    ok, line = compare_one(spark, duck(SF01), name, queries.QUERIES[name], queries.ORACLES[name], SF01)
    assert ok, line


# ---- manifest

def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, by the definition."""
    def leaf(r, more=0):
        values = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def up(node, tree, i):
        siblings = []
        for level in tree[:-1]:
            other = level[i ^ 1] if i ^ 1 < len(level) else ""
            node = sha(other, node) if i & 1 else sha(node, other)
            siblings.append(other)
            i >>= 1
        return node, siblings

    langs = defaultdict(list)
    for r in rows:
        langs[r.lang].append(r)
    trees, order = {}, sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[x] = levels([leaf(r) for r in langs[x]])
    top = levels([trees[x][-1][0] for x in order])
    out = []
    for j, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            node, low = up(leaf(r, int(hit)), trees[x], i)
            folded, high = up(node, top, j)
            out.append((r.doc_id, leaf(r), trees[x][-1][0], top[-1][0], sha(*low, *high), folded, folded == top[-1][0]))
    return sorted(map(str, out))


def held(df):
    return sorted(str(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")))
                  for r in df.collect())


def odd_documents(spark):
    r = random.Random(5)
    rows = [(i * 37 - 900, "t" * (i % 5), r.choice(["en", "de", None, ""]), "s", i) for i in range(300)]
    rows += [(7, f"another {i}", "en", "s", 1) for i in range(90)]              # one id, many texts
    rows += [(8, "the same row", "en", "s", 3)] * 70                            # one row, many times
    rows += [(None, f"no id {i % 3}", "en", None, None) for i in range(20)]
    rows += [(2 ** 63 - 1, None, "fr", None, 2 ** 63 - 1), (-2 ** 63, "", "fr", "", None), (3, "é" * 90_000, "it", "x", 0)]
    return spark.createDataFrame(rows, ODD)


def test_manifest_of_odd_rows(spark):
    docs = odd_documents(spark)
    want = plain_manifest(docs.collect())
    assert held(manifest.digest(docs)) == want
    clashing = docs.select("*", F.lit(1).alias("pos"), F.lit("x").alias("leaf"), F.lit("y").alias("lang_key"), F.lit(2).alias("m"))
    assert held(manifest.digest(clashing.repartition(7))) == want
    assert manifest.digest(docs.limit(0)).count() == 0
    one = docs.limit(1)
    assert held(manifest.digest(one)) == plain_manifest(one.collect())


def test_manifest_with_small_blocks_directories_and_pieces(spark, monkeypatch):
    """Many rounds, directory levels and pieces of equal rows on few rows."""
    for name, value in (("BLOCK_BITS", 4), ("DIRECTORY_BITS", 8), ("PIECE", 16), ("TOP", 6)):
        monkeypatch.setattr(manifest, name, value)
    docs = odd_documents(spark)
    assert held(manifest.digest(docs)) == plain_manifest(docs.collect())


def test_places_are_gapless_and_paths_lead_to_the_root(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = manifest.manifest(docs).collect()
    at = defaultdict(list)
    for r in rows:
        at[r.lang_key].append(r.pos)
        assert manifest.fold(r.leaf.hex(), r.path) == r.root.hex()
        assert manifest.fold("0" * 64, r.path) != r.root.hex()
    assert all(sorted(p) == list(range(len(p))) for p in at.values()) and len(rows) == docs.count()


# ---- token counts

def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


needs_model = pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no tokenizer file")
PIECES = ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "中", "<s>", "</s>", "<0x0A>", "😀", "\x00", "　", "ing", "."]


def library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    return [len(sp.encode(t or "")) for t in texts]


@needs_model
def test_runs_add_up_to_the_library(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    counter = token_counts.Counter(token_counts.load(model_path()))
    plain = [t.replace(token_counts.MARK, " ") for t in texts]
    assert counter.counts(plain) == library(texts)
    for name, value in (("LONG_TEXT", 5), ("PART_RUNS", 2), ("MEMO_CHARS", 50)):   # long texts in parts, a short memory
        monkeypatch.setattr(token_counts, name, value)
    assert [n for i in range(0, 5000, 10) for n in counter.counts(plain[i:i + 10])] == library(texts)


@needs_model
def test_counts_of_documents_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 60_000), (3, "word " * 60_000), (None, "a b"),
                                 (5, "a▁b"), (6, " "), (7, "x" * 5000)] + [(100 + i, "the same") for i in range(50)], docs.schema)
    both = docs.unionByName(odd)
    texts = both.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n, n > 4096) for r, n in zip(texts, library([r.text for r in texts])))
    got = token_counts.digest(both.select("*", F.lit(1).alias("content"), F.lit(2).alias("N_tokens"), F.lit(3).alias("_salt")), model_path())
    assert Counter(map(tuple, got.collect())) == want
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    empty = str(tmp_path / "none")
    assert token_counts.digest(docs.limit(0), model_path(), empty).count() == 0 and not os.path.exists(empty)


@needs_model
def test_cache_encodes_only_distinct_misses(spark, tmp_path, monkeypatch):
    cache, model = str(tmp_path / "cache"), token_counts.load(model_path())
    first = spark.createDataFrame([(i, f"text {i % 5}", "kept") for i in range(40)], "doc_id long, text string, content string")
    rows = token_counts.with_counts(first, model, cache)
    assert rows.columns == ["doc_id", "text", "content", "n_tokens"] and rows.count() == 40
    stored = spark.read.parquet(cache)
    assert stored.count() == 5 and {r.tokenizer for r in stored.collect()} == {token_counts.version(model)}
    more = first.unionByName(spark.createDataFrame([(90, "text 4", ""), (91, "new", ""), (92, "new", ""), (93, "text▁4", "")], first.schema))
    want = library([r.text for r in more.orderBy("doc_id").collect()])
    assert [r.n_tokens for r in token_counts.with_counts(more, model, cache).orderBy("doc_id").collect()] == want
    assert spark.read.parquet(cache).count() == 6                   # one miss, and a space mark is a space
    files = sorted(f for _, _, fs in os.walk(cache) for f in fs)
    assert token_counts.with_counts(more, model, cache).count() == 44
    assert sorted(f for _, _, fs in os.walk(cache) for f in fs) == files        # warm: nothing is written
    # stored counts are what comes back: a planted entry shows
    key = hashlib.sha256(b"planted").digest()
    spark.createDataFrame([(token_counts.version(model), bytearray(key), 77)], token_counts.CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)
    planted = spark.createDataFrame([(1, "planted", "")], first.schema)
    assert token_counts.with_counts(planted, model, cache).first().n_tokens == 77
    # another rule is another tokenizer, and an entry that was appended twice counts once
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(str(tmp_path / "twice"))
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(str(tmp_path / "twice"))
    assert token_counts.with_counts(more, model, str(tmp_path / "twice")).count() == 44
    monkeypatch.setattr(token_counts, "RULE", "another")
    assert token_counts.with_counts(planted, model, cache).first().n_tokens == library(["planted"])[0]


# ---- fill-in-middle

def plain_fim(doc_id, text):
    text = text or ""
    n, digest = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def fim_rows(spark):
    r = random.Random(2)
    marks = ["<", "P", ">", "<P>", "<S", "é", "😀", "\n", "words ", "M>"]
    rows = [(i, "".join(r.choice(marks[:3] + marks[4:] if i % 9 else marks) for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(None, "no id"), (1000, None), (1001, ""), (1002, "x😀y " * 40_000), (1002, "x😀y " * 40_000), (1003, "a<M>b")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("units", [3, 7, fim.FRAME_UNITS])
def test_fim_of_odd_rows(spark, units):
    docs = fim_rows(spark)
    if units < 10:
        docs = docs.where(F.length("text") < 1000)
    texts = sorted(str((r.doc_id, *plain_fim(r.doc_id, r.text), r.text or "")) for r in docs.collect())
    made = fim.restore(fim.transform(fim.store(docs.repartition(3), frame_units=units)))
    made = fim.with_text(fim.with_text(made, "output", "output_text"), "restored", "restored_text")
    got = sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_text, r.restored_text)) for r in made.collect())
    assert got == texts
    forms = Counter(r.form for r in made.select("form").collect())
    assert set(forms) == {"plain", "psm", "spm"}


def test_fim_columns_clash_and_empty_tables(spark):
    docs = fim_rows(spark).select("*", F.lit("x").alias("frames"), F.lit("y").alias("Form"), F.lit(1).alias("kept"))
    made = fim.restore(fim.transform(fim.store(docs)))
    assert made.columns == ["doc_id", "kept", "frames", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert made.count() == docs.count() and fim.digest(docs.limit(0)).count() == 0


def test_spans_open_only_the_frames_with_a_cut(spark):
    class Watched(fim.Codec):
        opened = 0

        def text(self, frame):
            self.opened += 1
            return super().text(frame)

    codec, text = Watched(10), "".join(chr(97 + i % 26) for i in range(1000))
    frames = codec.cut(text)
    assert len(frames) == 100 and [u for u, _ in frames] == [10] * 100
    part = codec.span(frames, 15, 905)
    assert codec.opened == 2 and "".join(codec.text(d) for _, d in part) == text[15:905]
    taken = fim.take(fim.store(spark.createDataFrame([(text, 15, 37), (None, 0, 4)], "text string, a long, b long"), frame_units=10), "a", "b")
    assert [r.taken for r in taken.collect()] == [text[15:37], ""]
