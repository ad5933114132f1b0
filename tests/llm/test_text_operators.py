"""BPE, suffix dedup, fingerprints, license scans against the library and plain statements."""

import hashlib
import os
import random
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest

from conftest import SF001, SF01
from dialmetrics.llm import blocks, bpe, fingerprints, license_scan, substrings
from dialmetrics.llm.queries import tokenizer_path
from dialmetrics.llm.suffixes import suffix_arrays

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer_path()), reason="no tokenizer file")

ODD = [(1, None), (2, ""), (3, "<|endoftext|>a<|endoftext|>  x "), (4, "日本語 テキスト 🙂  x y z"),
       (4, "日本語 テキスト 🙂  x y z"), (None, "a\n\n b  c\t\r\n it's 12'll"), (5, "word " * 30000),
       (6, "́̀ ..,;''s '"), (7, "x" * 5000)]


@pytest.fixture(scope="module")
def content():
    return bpe.load(tokenizer_path())


def test_fast_split_is_the_librarys(content):
    own = bpe.Splitter(bpe.specials(content)).own
    for c in range(0x300):
        ch = chr(c)
        for t in (ch, f"a{ch}b", f" {ch} ", f"{ch}{ch}1{ch}", f"1{ch} !{ch}", f"'{ch}", f"  {ch}x"):
            assert bpe.WORDS.findall(t) == [t[a:b] for _, (a, b) in own.pre_tokenize_str(t)], (hex(c), t)


@pytest.mark.parametrize("block", [6_000_000, 3_000])
def test_encoding_and_decoding_are_the_librarys(spark, content, block):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame(ODD, "doc_id long, text string"))
    out = bpe.decode(bpe.encode(docs, content, block_bytes=block), content)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    lib = Tokenizer.from_str(content)
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), ids, lib.decode(ids, skip_special_tokens=False)))
    got = [(str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out.collect()]
    assert sorted(got) == sorted(want)


def test_words_are_numbered_and_joined_by_place():
    words = ["b", "é", " a", "", "ccc"]
    number = bpe.Numbers()
    places = np.array([number[w] for w in [*words, "é", "b"]], np.int32)
    assert list(number) == words and places.tolist() == [0, 1, 2, 3, 4, 1, 0]
    asked, order = bpe.requests(number, 3)
    assert [b for b, _ in asked] == sorted({zlib.crc32(w.encode()) % 3 for w in words})
    assert [w for _, ws in asked for w in ws] == [words[i].encode() for i in order]
    assert bpe.requests([], 3)[0] == []
    items = pa.concat_arrays([blocks.unpack_array(blocks.pack(ws)) for _, ws in asked])
    to = np.empty(len(order), np.int32)
    to[order] = np.arange(len(order))
    ends = np.array([0, 3, 3, 7])
    assert blocks.joined(items, to[places], ends).to_pylist() == [b"", "bé a".encode(), b"", "cccéb".encode()]
    assert blocks.unpack_array(blocks.pack([])).to_pylist() == []


def test_decoding_any_ids(spark, content):
    from tokenizers import Tokenizer

    lib, rnd = Tokenizer.from_str(content), random.Random(1)
    rows = [[rnd.randrange(50257) for _ in range(rnd.randint(0, 40))] for _ in range(200)]
    df = spark.createDataFrame([(i, bytearray(np.array(r, "<u4").tobytes())) for i, r in enumerate(rows)], "i int, ids binary")
    got = {r.i: r.decoded for r in bpe.decode(df, content).collect()}
    assert all(got[i] == lib.decode(r, skip_special_tokens=False) for i, r in enumerate(rows))


def test_encoding_of_no_rows_and_clashing_names(spark, content):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(df, tokenizer_path()).count() == 0
    with pytest.raises(ValueError, match="name another"):
        bpe.encode(df.withColumnRenamed("doc_id", "ids"), content)
    other = spark.createDataFrame([(1, "a b", "x", 2)], "ids long, text string, block string, words int")
    r = bpe.encode(other, content, out="tokens").first()
    assert (r.ids, r.block, r.words) == (1, "x", 2) and len(r.tokens) == 8


# ---- suffix arrays

def test_suffix_arrays_are_sorted():
    rnd = random.Random(1)
    for trial in range(150):
        strings = [[rnd.randint(1, a) for _ in range(rnd.randint(0, 40))] + [0]
                   for a in (rnd.choice([1, 2, 3, 26]) for _ in range(rnd.randint(1, 6)))]
        if trial % 7 == 0:
            strings.append([1] * 30 + [0])
        starts = np.cumsum([0] + [len(s) for s in strings[:-1]])
        got = suffix_arrays(np.array(sum(strings, [])), starts)
        want = [b + i for b, s in zip(starts, strings, strict=True) for i in sorted(range(len(s)), key=lambda i: s[i:])]
        assert list(got) == want
    assert len(suffix_arrays(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


REPEATS = [(1, None), (2, ""), (3, "a" * 500), (4, "a" * 60 + "b" * 70), (4, "a" * 60 + "b" * 70), (5, "x" * 49),
           (6, "é" * 300 + "b" * 55), (None, "b" * 80), (None, "b" * 80), (7, "q" + "a" * 50 + "q")]


@pytest.mark.parametrize("ids", [[1, 2, 3, 4], [9, 2, 9, 1], [5, 5, 5, 5]])
def test_anchors_count_documents(ids):
    texts = [b"the same passage of sixty bytes and more, which comes again and again here" * k for k in (1, 2, 1)]
    runs = substrings.Runs([*texts, bytes(range(120))], 50, 24)
    key, count, shard = substrings.anchors(runs, np.array(ids), 5)
    want = {}
    for k, d in zip(runs.key.tolist(), runs.doc.tolist(), strict=True):
        want.setdefault(k, set()).add(ids[d])
    assert dict(zip(key.tolist(), count.tolist(), strict=True)) == {k: len(v) for k, v in want.items()}
    again, _ = substrings.in_shard_order(np.sort(key), 5)
    assert np.sort(key)[again].tolist() == key.tolist() and (np.diff(shard) >= 0).all()
    none = substrings.anchors(substrings.Runs([b"", b"short"], 50, 24), np.array([1, 2]), 5)
    assert [len(x) for x in none] == [0, 0, 0]


def test_the_last_step_reuses_the_blocks_and_their_places(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "z" * 60) for i in range(20)], "doc_id long, text string")
    out = substrings.mark_repeats(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "own#" in plan       # a block's places of segments come back with its answers
    assert sum(len(r.removed) for r in out.collect()) == 19


@pytest.mark.parametrize("block,hot,string", [(8_000_000, 2000, 4096), (100_000, 10, 4096), (300_000, 40, 100)])
def test_removed_passages(spark, monkeypatch, block, hot, string):
    monkeypatch.setattr(substrings, "SHARD_BYTES", block)
    monkeypatch.setattr(substrings, "STRING", string)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").where("doc_id < 300").union(
        spark.createDataFrame(REPEATS, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    cov = plain.covered(rows)
    want = sorted((str(d), (t or "").encode()[:0] + bytes(np.frombuffer((t or "").encode(), np.uint8)[~c]),
                   int(c.sum()), int((np.diff(np.r_[False, c].astype(np.int8)) == 1).sum()))
                  for (d, t), c in zip(rows, cov, strict=True))
    out = substrings.mark_repeats(docs, hot=hot, block_bytes=block)
    got = sorted((str(r.doc_id), bytes(r.kept), sum(b - a for a, b in r.removed), len(r.removed)) for r in out.collect())
    assert got == want and sum(w[2] for w in want) > 1000


def test_removal_keeps_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "z" * 60, "r", 1), (2, "z" * 60, "k", 2)],
                               "doc_id long, text string, removed string, block int")
    out = substrings.mark_repeats(df)
    assert out.columns[:4] == df.columns and len(set(out.columns)) == 6
    assert {r.doc_id: bytes(r.kept) for r in out.collect()} == {1: b"z" * 60, 2: b""}
    assert substrings.digest(df.limit(0)).count() == 0


# ---- fingerprints

def test_collisions_estimate_generalised_jaccard():
    rnd, sampler = random.Random(6), fingerprints.Sampler(512)
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        a = [rnd.choice([f"w{i}" for i in range(150)]) for _ in range(400)]
        b = [w if rnd.random() < share else f"v{rnd.randrange(150)}" for w in a]
        s = sampler.sketches([" ".join(a).encode(), " ".join(b).encode()])
        want = plain.jaccard(" ".join(a), " ".join(b))
        assert abs(fingerprints.likeness(s[:1], s[1:])[0] - want) < 0.08, share


def test_samples_do_not_depend_on_the_company():
    texts = [b"a b c a", b"d e f", b"", b"a", b"x " * 70000]
    together = fingerprints.Sampler().sketches(texts)
    alone = np.array([fingerprints.Sampler().sketches([t])[0] for t in texts])
    assert (together == alone).all() and not together[2].any() and together[0].all()


def test_quantiles():
    q = fingerprints.gamma2_quantiles(1000)
    assert np.allclose(1 - (1 + q) * np.exp(-q), (np.arange(1000) + 0.5) / 1000)


ORDER = [(30, "c c c"), (10, "a b c d e f g h"), (20, "é日x" * 3), (None, "n1 n1"), (None, None), (20, "other text of twenty"),
         (40, ""), (50, "long " * 20000), (50, "long " * 20000)]


@pytest.mark.parametrize("rows", [1024, 2])
def test_edited_texts(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", rows)
    monkeypatch.setattr(fingerprints.in_order, "__defaults__", (rows,))
    docs = spark.createDataFrame(ORDER, "doc_id long, text string")
    h = {r.text: r.h & (2 ** 63 - 1) if r.h >= 0 else (r.h + 2 ** 64) >> 1 for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) h").collect()}
    h = {t: (v if False else None) for t, v in h.items()}
    key = {r.text: r.k for r in docs.selectExpr("text", "shiftrightunsigned(xxhash64(coalesce(text, '')), 1) k").collect()}
    order = sorted(ORDER, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]], r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, f = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[:len(t) - n] + f[:n]).encode()).hexdigest()))
    got = fingerprints.with_edits(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 256
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(prints[50]) == 1


def test_next_likeness_of_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprints.with_edits(docs).collect()}
    assert len(got) == len(rows)
    off = []
    for i, r in enumerate(rows):
        f = rows[(i + 1) % len(rows)].text
        off.append(abs(got[r.doc_id].near_next - plain.jaccard(r.text, f)))
        off.append(abs(got[r.doc_id].near_edited - plain.jaccard(r.text, fingerprints.edited(r.text, f))))
    assert np.mean(off) < 0.05


def test_fingerprint_column(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "s"), (3, "b a", "s")], "doc_id long, text string, h string")
    out = fingerprints.fingerprint(df)
    assert out.columns == ["doc_id", "text", "h", "fingerprint"]
    got = {r.doc_id: r.fingerprint for r in out.collect()}
    assert got[1] == got[3] != got[2]
    with pytest.raises(ValueError, match="name another"):
        fingerprints.fingerprint(out)
    one = fingerprints.with_edits(df.limit(1)).first()
    assert one.near_next == 1.0
    assert fingerprints.with_edits(df.limit(0)).count() == 0


# ---- licenses

def test_license_notices(spark):
    filler = "Some words about nothing. " * 200
    docs = [(1, f"{filler}\nReleased under the MIT License.\n{filler}"),
            (2, "This work is licensed under the GNU General Public License, version 3."),
            (3, "This work was licensed under the GNU General Public License, version 3."),
            (4, filler), (5, None), (6, ""), (7, "The license of the poet."), (8, "All rights reserved.\nAll rights reserved."),
            (9, "Licensed under CC BY 4.0."), (10, "Licensed under CC BY-NC 4.0."), (10, "Licensed under CC BY-NC 4.0."),
            (None, "Licensed under the Apache License, Version 2.0.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, license string")
    rows = license_scan.scan_licenses(df).collect()
    got = sorted((str(r.doc_id), r.license, r.exact) for r in rows)
    assert got == sorted([("1", "MIT", True), ("2", "GPL-3.0", True), ("3", "GPL-3.0", False),
                          ("8", "all-rights-reserved", True), ("8", "all-rights-reserved", True),
                          ("9", "CC-BY-4.0", True), ("10", "CC-BY-NC-4.0", True), ("10", "CC-BY-NC-4.0", True),
                          ("None", "Apache-2.0", True)])
    three = next(r for r in rows if r.doc_id == 3)
    assert (three.missing, three.extra) == ("is", "was") and three.similarity < 1
    text = docs[0][1]
    one = next(r for r in rows if r.doc_id == 1)
    assert text[one.start:one.end] == "Released under the MIT License"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_every_template_has_a_cue_and_ranks_first():
    scanner = license_scan.Scanner()
    for i, (_, wording) in enumerate(license_scan.TEMPLATES):
        assert any(c in wording.lower() for c in license_scan.CUES)
        assert scanner.ranked(wording.encode())[0][1] == i
        found = scanner.scan("x y z\n" + wording + "\nx y z")
        assert len(found) == 1 and found[0]["exact"]


@pytest.mark.parametrize("columns", [20, 40, 80])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(columns, mark):
    import textwrap
    scanner = license_scan.Scanner()
    for name, wording in license_scan.TEMPLATES:
        body = "\n".join(mark + x for x in textwrap.wrap(wording, columns, break_long_words=False, break_on_hyphens=False))
        for text in (body, f"{mark}some words of code\n{body}\n{mark}other words of code here"):
            found = scanner.scan(text)
            assert [(r["license"], r["exact"]) for r in found] == [(name, True)], (name, text, found)


def test_wrapped_notices_of_a_table(spark):
    text = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\n" \
           "documentation files, to deal in the software without\nrestriction."
    df = spark.createDataFrame([(1, text), (2, "ALL RIGHTS\n# RESERVED"), (3, "dedicated to the public")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.exact) for r in license_scan.scan_licenses(df).collect()) == [
        (1, "MIT", True), (2, "all-rights-reserved", True)]


@pytest.mark.parametrize("around", ["x" * 60 + " ", "word of a long line, " * 12, "The license of the poet permits copyright of songs. " * 6])
def test_notices_beside_other_text(around):
    scanner = license_scan.Scanner()
    for name, wording in license_scan.TEMPLATES:
        for text in (around + wording, wording + " " + around, around + wording + " " + around, around + wording.upper()):
            assert [(r["license"], r["exact"]) for r in scanner.scan(text)] == [(name, True)], (name, text)


def test_long_texts_of_notices():
    parts = [w for _, w in license_scan.TEMPLATES] * 40
    found = license_scan.Scanner().scan("\n".join(parts))
    assert len(found) == len(parts) and all(r["exact"] for r in found)


def test_license_of_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = {(r.doc_id, name) for r in docs.collect() for name, wording in license_scan.TEMPLATES if wording in r.text}
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect() if r.exact}
    assert got == want and want
