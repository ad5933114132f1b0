"""Hash-tree sharding and mixing against plain statements, with the odd rows."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import plain
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF01
from dialmetrics.llm import mixing, sharding

ODD = [(1, None, "a"), (2, "", "a"), (3, "x " * 5000, "b"), (3, "x " * 5000, "b"), (None, "no id", None),
       (None, "other text", None), (4, "éè \t\n\x0b z", "c"), (5, "   ", "d")]


def odd(spark):
    return spark.createDataFrame([(i, t, s, 0, 0.5) for i, t, s in ODD],
                                 "doc_id long, text string, source string, size int, mix_size double")


def test_shards_and_slots(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "source").unionByName(
        odd(spark).select("doc_id", "text", "source"))
    rows = sharding.shard_documents(docs).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    got = Counter()
    for r in rows:
        got[(r.doc_id, r.size, r.text_crc32)] += 1
        assert 0 <= r.shard < 24 and r.law == "key"
        assert r.grown_shard == r.shard or r.grown_shard == 24      # the new shard takes rows only into itself
    want = Counter()
    for (i, t), n in texts.items():
        b = (t or "").encode()
        want[(i, len(b) + 8, zlib.crc32(b))] += n
    assert got == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 24 for r in rows)
    assert rows and sorted(map(str, rows)) == sorted(map(str, sharding.shard_documents(docs.repartition(7)).collect()))


def test_growth_takes_rows_only_into_the_new_shard(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    seen = ids
    for n in (24, 25, 26, 30):
        seen = sharding.assign(seen, sharding.tree(n), f"s{n}")
    rows = seen.collect()
    for a, b in ((24, 25), (25, 26), (26, 30)):
        moved = [(r[f"s{a}"], r[f"s{b}"]) for r in rows if r[f"s{a}"] != r[f"s{b}"]]
        assert moved and all(y >= a for _, y in moved)
    share = Counter(r.s30 for r in rows)
    assert all(abs(share[s] / 20000 - 1 / 30) < 0.01 for s in range(30))


def plain_shard(node, key, seed=sharding.SEED):
    """The descent by its definition: the smallest -ln(u) / weight among a node's children, level by level."""
    path = ""
    while node.children:
        best = []
        for child in node.children:
            h = 42
            for part in (seed, f"{path}/{child.name}", *key):
                if part is not None:
                    h = xxhash.xxh64_intdigest(part.encode() if isinstance(part, str) else struct.pack("<q", part), h)
            best.append((-math.log(((h >> 12) + 0.5) * 2.0 ** -52) / child.total, f"{path}/{child.name}", child))
        _, path, node = min(best, key=lambda b: b[:2])
    return node.shard


@pytest.mark.parametrize("shards", [24, 25, 31])
def test_draws_equal_the_plain_descent(spark, shards):
    """On an even tree, a grown one and one of uneven weights; rows without an id draw by their text."""
    ids = [(i, "t") for i in (0, 1, 2, -7, 2 ** 62, *range(100, 400))] + [(None, f"text {i}") for i in range(20)] + [(None, None)]
    docs = spark.createDataFrame(ids, "doc_id long, text string")
    for weights in (None, [1.0 + i % 5 for i in range(shards)]):
        layout = sharding.tree(shards, weights=weights)
        got = Counter((r.doc_id, r.text, r.shard) for r in sharding.assign(docs, layout).collect())
        want = Counter((i, t, plain_shard(layout, (i, (t or "") if i is None else None))) for i, t in ids)
        assert got == want


def test_a_changed_weight_moves_rows_only_at_its_leaf(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    base = sharding.tree(24)
    region, other = base.children
    rack = region.children[0]
    heavy = sharding.Node(rack.children[0].name, 3.0, rack.children[0].shard)
    # the rack's weight grows with the leaf's: rows come to this rack, and none moves in other racks
    new = sharding.Node("root", children=(sharding.Node(region.name, children=(
        sharding.Node(rack.name, children=(heavy, *rack.children[1:])), *region.children[1:])), other))
    rows = sharding.assign(sharding.assign(ids, base, "a"), new, "b").collect()
    inside = {c.shard for c in rack.children}
    own = {c.shard for k in region.children for c in k.children}
    for r in rows:
        if r.a != r.b:
            assert r.b in own
            if r.a in own:
                assert r.b in inside


def test_shards_of_no_rows(spark):
    out = sharding.shard_documents(odd(spark).limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 50, "d": 7, None: 400}, {"z": 0, "y": 10}, {"q": 0},
    {f"s{i:02d}": (i * 37) % 11 * 100 for i in range(23)}])
def test_targets_are_water_levels(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(df).collect()}
    want = plain.targets(sizes)
    assert set(got) == set(want)
    for s in want:
        assert got[s][0] == sizes[s] and got[s][1] == pytest.approx(want[s])


def test_mix_matches_its_rates(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "source").unionByName(
        odd(spark).select("doc_id", "text", "source"))
    rows = mixing.digest(docs).collect()
    count = Counter()
    for r in docs.collect():
        count[r.source] += len(plain.words(r.text))
    want = plain.targets(count)
    sizes = Counter((r.doc_id, len(plain.words(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.size) for r in rows) == sizes
    by = {}
    source = {r.doc_id: r.source for r in docs.collect() if r.doc_id is not None}
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.doc_id is not None:
            s = source[r.doc_id]
            by[s] = (r.source_size, r.target)
            taken[s] += r.taken
    for s, (size, target) in by.items():
        assert size == count[s] and target == pytest.approx(want[s])
        if s and s.startswith("src"):
            assert abs(taken[s] - target) < 0.35 * size
    assert abs(sum(taken.values()) - 1.5 * sum(count.values())) < 0.05 * sum(count.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.digest(docs.repartition(5)).collect()))


def test_mix_emits_rows_with_their_columns(spark):
    docs = odd(spark)
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    n = mixing.mix(docs)
    assert n.columns[:len(docs.columns)] == docs.columns and len(set(n.columns)) == len(docs.columns) + 4
    per = Counter({str(tuple(r)[:5]): 0 for r in docs.collect()})
    for r in n.collect():
        per[str(tuple(r)[:5])] += r[-1]
    assert Counter(str(tuple(r)) for r in out.collect()) == +per
    assert mixing.emit(docs.limit(0)).count() == 0 and mixing.digest(docs.limit(0)).count() == 0


def test_shuffle_join_beyond_the_broadcast_bound(spark, monkeypatch):
    a = sorted(map(str, mixing.digest(odd(spark)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.digest(odd(spark)).collect())) == a


def test_plans_hold_no_python(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    for df in (mixing.digest(docs), mixing.emit(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
