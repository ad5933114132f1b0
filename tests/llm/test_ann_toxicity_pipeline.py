"""Nearest neighbours against brute force, toxicity on held-out rows, and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF001, SF01
from dialmetrics.llm import ann, bpe, lines, mixing, simhash, toxicity
from dialmetrics.llm.queries import QUERIES, tokenizer_path


def brute(rows, k=5):
    """rows: (vec_id, vector) that take part."""
    out = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        x = np.array(min(v for i, v in rows if i == q), np.float64)
        best = {}
        for i, v in rows:
            if i != q and len(v) == len(x):
                y = np.array(v, np.float64)
                s = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))
                best[i] = max(s, best.get(i, -2))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda z: (-z[1], z[0]))[:k], 1):
            out.append((q, rank, i, s))
    return out


def same(got, want):
    assert [w[:3] for w in want] == [g[:3] for g in got]
    assert np.allclose([w[3] for w in want], [g[3] for g in got], rtol=0, atol=1e-12)


@pytest.mark.parametrize("row_block", [4096, 60])
def test_neighbours_of_embeddings(spark, row_block):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, query_block=7, row_block=row_block).collect())
    same(got, brute(rows))


def test_neighbours_with_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(1, 90)]
    rows += [(0, [1.0, 0.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0, 0.0]), (100, [0.0] * 4), (150, [nan, 1.0, 0.0, 0.0]),
             (200, [1.0, None, 0.0, 0.0]), (250, None), (300, []), (350, [inf, 0.0, 0.0, 0.0]), (400, [1.0, 2.0]),
             (401, [2.0, 4.0]), (450, [1e-30, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    rows += [(500 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(1, 40)] + [(501, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, rank long, id string")
    bad = {None, 100, 150, 200, 250, 300, 350}
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, row_block=20).collect())
    same(got, brute([(i, v) for i, v in rows if i not in bad]))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 1100)), rng.normal(size=(70, 1100)) * 1e3
    (c, s, e), (d, t, f) = ann.quantise(a), ann.quantise(b)
    near = ann.products(c, d) * s[:, None] * t[None, :]
    true = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    assert (np.abs(near - true) <= e[:, None] + (1 + e[:, None]) * f[None, :] + ann.SLACK).all()
    assert e.max() < 0.03


# ---- toxicity

def test_gradient_finds_ordered_grades():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 6)) < 0.4
    w = np.array([2.0, -1.5, 1.0, 0.0, 0.5, -0.5])
    z = x @ w + rng.logistic(size=3000)
    y = (z > 0.5).astype(int) + (z > 2.0)
    doc, feature = np.nonzero(x)
    got, theta = toxicity.maximise(doc, feature, np.ones(len(doc)), y, 6, l2=0.1, steps=1500)
    assert np.abs(got - w).max() < 0.35 and np.abs(theta - [0.5, 2.0]).max() < 0.35 and theta[0] < theta[1]


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    graded = toxicity.grades(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    train = graded.where("doc_id % 2 = 0")
    model = toxicity.fit(docs, train)
    held = toxicity.score(docs, model).join(graded.where("doc_id % 2 = 1"), "doc_id").select("severity", "grade").collect()
    toxic = [r.severity >= toxicity.REJECT for r in held if r.grade > 0]
    clean = [r.severity >= toxicity.REJECT for r in held if r.grade == 0]
    assert np.mean(toxic) > 0.93 and np.mean(clean) < 0.005
    assert len(model.weights) <= toxicity.FEATURES and list(model.thresholds) == sorted(model.thresholds)


def test_toxicity_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "scum " * 20000, 1.0), (3, "scum " * 20000, 1.0),
                                  (None, "kind words", 1.0)], "doc_id long, text string, severity double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same_grade = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (3, 1, None)], none.schema)
    for labels in (none, same_grade):
        rows = toxicity.screen(docs, labels).collect()
        assert len(rows) == 5 and all(r.severity == 0 and not r.toxic for r in rows)
        assert toxicity.keep_clean(docs, labels).count() == 5
    assert toxicity.screen(docs.limit(0), same_grade).count() == 0
    many = spark.createDataFrame([(i, "bad thing" if i % 3 == 0 else "good thing", 0.5) for i in range(60)], docs.schema)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] * 2 + [(0, 0, 1)], none.schema)
    kept = toxicity.keep_clean(many, labels)
    assert kept.columns == many.columns and {r.doc_id % 3 for r in kept.collect()} == {1, 2}
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


# ---- pipeline

@pytest.mark.skipif(not os.path.exists(tokenizer_path()), reason="no tokenizer file")
def test_pipeline_applies_every_stage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    clean = toxicity.keep_clean(docs, labels)
    deduped = lines.dedup_lines(clean).select(*docs.columns).withColumn("n_chars", F.length("text"))
    one = simhash.keep_one(deduped)
    mixed = mixing.emit(one)
    content = bpe.load(tokenizer_path())
    want = bpe.encode(mixed.select("doc_id", "text"), content)
    want = sorted((r.doc_id, bytes(r.ids)) for r in want.collect())
    got = corpus_pipeline.run(spark, SF001).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == want and all(r.round_trip for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]


@pytest.mark.skipif(not os.path.exists(tokenizer_path()), reason="no tokenizer file")
def test_stages_keep_the_columns_and_take_no_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "src1", 0),
                                 (None, "a text without an id", "en", None, 20)], docs.schema)
    for rows in (docs.limit(0), odd):
        at = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SF001)
            assert at.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, at, SF001).collect()


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
