"""Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

A row's leaf is the sha256 of its fields. Within a language, leaves ascend by
doc_id and are reduced two by two to the language's subroot; the subroots, by
language, are reduced likewise to the root.

Coordinates, without sorting the leaves. A language's doc_ids are a compressed
bitmap: one 64-bit word for each run of 64 ids in which some id occurs (``bit_or``,
merged map-side and then by word) with its number of rows. A directory of counts
stands over the words: sums for each 2^16 words, for each 2^16 of these and so on
(``DIRECTORY_BITS``), each prefixed within its parent only, so a step looks at
65,536 entries at most, however many rows a language has and however sparse its
ids are. A leaf's place is the start of its word plus the number of bits below its
own in the word (``bit_count``).

Levels, by keyed slot arrays. A place's upper bits are the key of its block, its
low ``BLOCK_BITS`` bits the slot: a block is an array of 1,024 slots that its rows
fill in any order, and one task step reduces it by ten levels to one node. Block
nodes are the leaves of the next round; the number of rounds is the logarithm of
the largest language to the base 1,024. On the way down every block hands its
slots their siblings, so a proof needs no look-up of nodes.

Ties. Repeated doc_ids (and rows without one) are ordered by leaf, through the same
directory over the leaf's first 60 bits within the id; equal rows are counted
before anything moves and dealt consecutive places afterwards, in pieces.

Kept between rounds (checkpoint, the shared folder): leaves, words, and the blocks
with their slots; everything later repeats from there when an executor is lost. To
the driver comes one number, the rows of the largest language.

Defined results: nulls hash as ``-``; a null lang is a language of its own, the
first; rows without a doc_id come first in their language and are never tampered
with; empty and very long texts hash whole; equal rows have places (and proofs) of
their own; an empty table gives an empty table; other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import from_bytes, to_bytes
from .text import need

BLOCK_BITS = 10             # slots of a block: 1,024
WORD_BITS = 6               # ids of a word: 64
DIRECTORY_BITS = 16         # words (or sums of words) under one entry of the directory
TOP = 3                     # levels of the directory over the words: 6 + 3 * 16 bits, and 10 at the top
PIECE = 65_536              # equal rows dealt their places at a time
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- leaves

def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    """A row's leaf (binary); ``n_chars`` may stand in for the column."""
    fields = [F.col(c) if c != "n_chars" or n_chars is None else n_chars for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]).cast("binary"), 256))


def tampered() -> Column:
    """The leaf after tampering, or null where the row is left as it is."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return F.when(chosen & F.col("n_chars").isNotNull(), leaf(more))


def leaves(docs: DataFrame) -> DataFrame:
    """``lang_key, none, id, leaf, changed, m``: the distinct leaves and how many rows have them.

    ``lang_key`` is ``n`` for a null lang and ``s`` before the others, so it orders as the langs do.
    """
    need(docs, *FIELDS)
    rows = docs.select(F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n")).alias("lang_key"),
                       F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                       leaf().alias("leaf"), tampered().alias("changed"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m"))


# ---- ranks

def _with_starts(nodes: DataFrame, group: list[str], node: str, level: int = 0) -> DataFrame:
    """``nodes`` (a row for each group and node, ``n`` rows each) plus ``start``: the rows of the group's smaller nodes."""
    order = Window.orderBy(node).rowsBetween(Window.unboundedPreceding, -1)
    if level == TOP:        # ten bits are left
        return nodes.withColumn("start", F.coalesce(F.sum("n").over(order.partitionBy(*group)), F.lit(0)))
    up = f"up{level}"
    nodes = nodes.withColumn(up, F.shiftright(node, DIRECTORY_BITS))
    over = _with_starts(nodes.groupBy(*group, up).agg(F.sum("n").alias("n")), group, up, level + 1)
    before = F.coalesce(F.sum("n").over(order.partitionBy(*group, up)), F.lit(0))
    return (nodes.withColumn("before", before).join(over.select(*group, up, "start"), [*group, up])
            .withColumn("start", F.col("start") + F.col("before")).drop("before", up))


def _word(key: str) -> Column:
    return F.shiftright(key, WORD_BITS)


def _bit(key: str) -> Column:
    return (F.col(key).bitwiseAND(F.lit(2 ** WORD_BITS - 1))).cast("int")


def _power(bit: Column, of: int = 1) -> Column:
    return F.call_function("shiftleft", F.lit(of).cast("long"), bit)


def words(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """The groups' bitmaps: ``word``, its ``mask`` of ids, and its ``n`` rows."""
    return (rows.groupBy(*group, _word(key).alias("word"))
            .agg(F.bit_or(_power(_bit(key))).alias("mask"), F.sum("m").alias("n")))


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each of ``m`` equal rows, at consecutive places from ``pos``; many of them spread over tasks."""
    once, many = rows.where("m = 1"), rows.where("m > 1")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(PIECE).cast("long")))
    pieces = many.withColumn("first", first).repartition("lang_key", "pos", "first")
    each = F.explode(F.sequence(F.col("first"), F.least(F.col("m"), F.col("first") + PIECE) - 1))
    dealt = pieces.withColumn("i", each).withColumn("pos", F.col("pos") + F.col("i")).drop("first", "i")
    return once.unionByName(dealt).drop("m")


def coordinates(found: DataFrame) -> DataFrame:
    """``lang_key, pos, size, doc_id, node, changed``: each row's place in its language of ``size`` rows."""
    group = ["lang_key", "none"]
    ensure_checkpoint_dir(found.sparkSession)
    bitmap = words(found, group, "id").checkpoint()
    sizes = bitmap.groupBy("lang_key").agg(
        F.sum("n").alias("size"), F.sum(F.when(F.col("none"), F.col("n")).otherwise(0)).alias("without_id"))
    directory = (_with_starts(bitmap, group, "word").join(sizes, "lang_key")
                 .withColumn("start", F.col("start") + F.when(F.col("none"), 0).otherwise(F.col("without_id")))
                 .drop("without_id"))
    rows = found.withColumn("word", _word("id")).join(directory, [*group, "word"])
    tied = F.col("n") != F.bit_count("mask")
    below = F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not(_power(_bit("id"), -1))))
    out = ["lang_key", "pos", "size", F.when(~F.col("none"), F.col("id")).alias("doc_id"), F.col("leaf").alias("node"), "changed"]
    placed = rows.where(~tied).withColumn("pos", F.col("start") + below).select(*out)
    if bitmap.where(tied).isEmpty():
        return placed
    return placed.unionByName(_copies(_among_ties(rows.where(tied).checkpoint())).select(*out))


def _among_ties(rows: DataFrame) -> DataFrame:
    """Places in words that hold an id more than once: by id, then by leaf."""
    one = ["lang_key", "none", "word", "id"]
    rows = rows.withColumn("head", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long"))
    ids = rows.groupBy(*one).agg(F.sum("m").alias("rows"))
    in_word = Window.partitionBy("lang_key", "none", "word").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.withColumn("ids_before", F.coalesce(F.sum("rows").over(in_word), F.lit(0))).drop("rows")
    of_id = ["lang_key", "none", "id"]
    heads = _with_starts(words(rows, of_id, "head").checkpoint(), of_id, "word")
    heads = heads.select(*of_id, F.col("word").alias("head_word"), F.col("start").alias("heads_before"))
    within = Window.partitionBy(*of_id, "head_word").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("head_word", _word("head")).join(ids, one).join(heads, [*of_id, "head_word"])
            .withColumn("last", F.coalesce(F.sum("m").over(within), F.lit(0)))
            .withColumn("pos", F.col("start") + F.col("ids_before") + F.col("heads_before") + F.col("last")))


# ---- levels

def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels over a block: up to one node, where it is the whole group, or by ``BLOCK_BITS`` levels."""
    levels = [nodes]
    while (len(levels[-1]) > 1) if whole else (len(levels) <= BLOCK_BITS):
        at = levels[-1]
        levels.append([h(*at[i:i + 2]) for i in range(0, len(at), 2)])
    return levels


def path_of(levels: list[list[str]], slot: int) -> str:
    """A slot's siblings, level by level: ``<`` or ``>`` (its side) and the node, ``.`` for none."""
    out = []
    for level in levels[:-1]:
        other = slot ^ 1
        out.append(("<" if slot & 1 else ">") + level[other] if other < len(level) else ".")
        slot >>= 1
    return "".join(out)


def steps(path: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(path):
        side, wide = path[at], 0 if path[at] == "." else 64
        yield side, path[at + 1:at + 1 + wide]
        at += 1 + wide


def fold(node: str, path: str) -> str:
    """The root that a node and its siblings give."""
    for side, other in steps(path):
        node = h(other, node) if side == "<" else h(node, other)
    return node


def _reduce(nodes: DataFrame) -> DataFrame:
    """One round: blocks of ``lang_key, pos, size, node`` and any other columns, as ``lang_key, block, size, slots, node``."""

    def work(table: pa.Table) -> pa.Table:
        pos = table.column("pos").to_numpy()
        size, block = table.column("size")[0].as_py(), int(pos[0]) >> BLOCK_BITS
        count = min(1 << BLOCK_BITS, size - (block << BLOCK_BITS))
        rows = np.full(count, -1, np.int64)
        rows[pos & ((1 << BLOCK_BITS) - 1)] = np.arange(len(pos))     # each row to its slot
        if len(pos) != count or (rows < 0).any():
            raise RuntimeError("the input's rows differ between scans; write it as a table first")
        slots = table.drop_columns(["lang_key", "pos", "size"]).take(pa.array(rows))
        top = reduced([n.hex() for n in slots.column("node").to_pylist()], size <= 1 << BLOCK_BITS)[-1][0]
        return pa.table({"lang_key": table.column("lang_key").slice(0, 1), "block": pa.array([block], pa.int64()),
                         "size": table.column("size").slice(0, 1), "slots": pa.array([to_bytes(slots)], pa.binary()),
                         "node": pa.array([bytes.fromhex(top)], pa.binary())})

    keyed = nodes.withColumn("block", F.shiftright("pos", BLOCK_BITS))
    return (keyed.groupBy("lang_key", "block")
            .applyInArrow(lambda t: work(t.drop_columns(["block"])), "lang_key string, block long, size long, slots binary, node binary"))


def grow(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The rounds up to one block for each group; ``most``: the size of the largest."""
    rounds = [_reduce(nodes).checkpoint()]
    while most > 1 << BLOCK_BITS:
        most = -(-most >> BLOCK_BITS)
        up = rounds[-1].select("lang_key", F.col("block").alias("pos"),
                               F.shiftright(F.col("size") + (1 << BLOCK_BITS) - 1, BLOCK_BITS).alias("size"), "node")
        rounds.append(_reduce(up).checkpoint())
    return rounds


def descend(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """``lang_key, block, path`` for the slots of ``blocks``: the blocks of the round below. Without ``above``, from the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                nodes = [n.hex() for n in from_bytes(r["slots"]).column("node").to_pylist()]
                levels = reduced(nodes, r["size"] <= 1 << BLOCK_BITS)
                yield pa.RecordBatch.from_pydict({
                    "lang_key": [r["lang_key"]] * len(nodes),
                    "block": [(r["block"] << BLOCK_BITS) + i for i in range(len(nodes))],
                    "path": [path_of(levels, i) + r["path"] for i in range(len(nodes))]})

    held = blocks.join(above, ["lang_key", "block"]) if above is not None else blocks.withColumn("path", F.lit(""))
    return (held.select("lang_key", "block", "size", "slots", "path")
            .mapInArrow(run, "lang_key string, block long, path string"))


def _paths(rounds: list[DataFrame], above: DataFrame | None) -> DataFrame | None:
    """``above`` taken down through the rounds, the last first."""
    for blocks in reversed(rounds):
        above = descend(blocks, above)
    return above


def _ranked(subroots: DataFrame) -> tuple[DataFrame, int]:
    """Subroots with their place by language, and how many there are. Sorted over tasks, then numbered by task."""
    ordered = (subroots.orderBy("lang_key").withColumn("task", F.spark_partition_id())
               .withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit(2 ** 33 - 1))).checkpoint())
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)      # a row for each task
    starts = (ordered.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
              .select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    total = ordered.count()
    ranked = ordered.join(starts, "task").select("lang_key", "node", (F.col("first") + F.col("i")).alias("pos"))
    return ranked.withColumn("size", F.lit(total).cast("long")), total


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each document: ``lang_key, pos, doc_id, leaf, subroot, root, path, changed``.

    ``path`` are the siblings from the leaf to the root (``path_of``); ``changed`` is the leaf after
    tampering, or null.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    found = leaves(docs).checkpoint()
    placed = coordinates(found)
    most = found.groupBy("lang_key").agg(F.sum("m").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = grow(placed, most)
    subroots = rounds[-1].select("lang_key", "node")
    ranked, langs = _ranked(subroots)
    over = grow(ranked.select(F.lit("").alias("lang_key"), "pos", "size", "node"), langs)
    root = over[-1].select("node").scalar()     # one row
    lang_paths = _paths(over, None).select(F.col("block").alias("pos"), "path")
    langs_top = ranked.join(lang_paths, "pos")
    above = (_paths(rounds[1:], langs_top.select("lang_key", F.lit(0).cast("long").alias("block"), "path"))
             .join(langs_top.select("lang_key", F.col("node").alias("subroot")), "lang_key")
             .withColumn("root", root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                slots = from_bytes(r["slots"])
                n = slots.num_rows
                levels = reduced([x.hex() for x in slots.column("node").to_pylist()], r["size"] <= 1 << BLOCK_BITS)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["lang_key"]] * n, pa.string()),
                    pa.array(np.arange(n) + (r["block"] << BLOCK_BITS), pa.int64()),
                    slots.column("doc_id").combine_chunks(), slots.column("node").combine_chunks(),
                    pa.array([r["subroot"]] * n, pa.binary()), pa.array([r["root"]] * n, pa.binary()),
                    pa.array([path_of(levels, i) + r["path"] for i in range(n)], pa.string()),
                    slots.column("changed").combine_chunks()],
                    names=["lang_key", "pos", "doc_id", "leaf", "subroot", "root", "path", "changed"])

    return (rounds[0].join(above, ["lang_key", "block"])
            .select("lang_key", "block", "size", "slots", "path", "subroot", "root")
            .mapInArrow(run, "lang_key string, pos long, doc_id long, leaf binary, subroot binary, root binary, "
                             "path string, changed binary"))


def verified(proved: DataFrame) -> DataFrame:
    """The contract's columns for rows of ``manifest``: each row's leaf, as it is now, folded with its siblings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["leaf", "root", "path", "changed"]).to_pylist()
            folded = [fold((r["changed"] or r["leaf"]).hex(), r["path"]) for r in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *[pa.array([x.hex() for x in batch.column(c).to_pylist()], pa.string())
                                          for c in ("leaf", "subroot", "root")],
                pa.array([h(*[other for _, other in steps(r["path"])]) for r in rows], pa.string()),
                pa.array(folded, pa.string()),
                pa.array([f == r["root"].hex() for f, r in zip(folded, rows, strict=True)], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return proved.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                  "folded_root string, verified boolean")


def digest(docs: DataFrame) -> DataFrame:
    return verified(manifest(docs))


def _sql_leaf(n_chars: str) -> str:
    fields = [n_chars if c == "n_chars" else c for c in FIELDS]
    return "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


# The same for DuckDB: places by row_number, levels and folding by recursion, CRC-32 bit by bit.
ORACLE_SQL = f"""WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_sql_leaf('n_chars')} AS leaf,
    {_sql_leaf('(CAST(n_chars AS HUGEINT) + 1)')} AS more, n_chars,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), CAST(4294967295 AS BIGINT)) AS crc FROM documents
), placed AS (
  SELECT rid, doc_id, lang, leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN more ELSE leaf END AS now,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM docs
), nodes(lang, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1
  GROUP BY lang, lvl, pos // 2, n
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1
  GROUP BY lvl, pos // 2, n
), proofs AS (
  SELECT p.rid, s.lvl AS step, s.h FROM placed p JOIN nodes s
    ON s.lang IS NOT DISTINCT FROM p.lang AND s.n > 1 AND s.pos = xor(p.pos >> s.lvl, 1)
  UNION ALL
  SELECT p.rid, 1000 + s.lvl, s.h FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
  JOIN tops s ON s.n > 1 AND s.pos = xor(r.pos >> s.lvl, 1)
), proof AS (
  SELECT rid, sha256(string_agg(h, '' ORDER BY step)) AS proof FROM proofs GROUP BY rid
), sizes AS (
  SELECT DISTINCT lang, lvl, n FROM nodes
), folds(rid, lang, pos, lvl, acc) AS (
  SELECT rid, lang, pos, 0, now FROM placed
  UNION ALL
  SELECT f.rid, f.lang, f.pos // 2, f.lvl + 1,
    sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.acc ELSE f.acc || coalesce(s.h, '') END)
  FROM folds f JOIN sizes z ON z.lang IS NOT DISTINCT FROM f.lang AND z.lvl = f.lvl AND z.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1)
), in_lang AS (
  SELECT rid, lang, max_by(acc, lvl) AS acc FROM folds GROUP BY rid, lang
), top_sizes AS (
  SELECT DISTINCT lvl, n FROM tops
), top_folds(rid, pos, lvl, acc) AS (
  SELECT i.rid, r.pos, 0, i.acc FROM in_lang i JOIN subroots r ON r.lang IS NOT DISTINCT FROM i.lang
  UNION ALL
  SELECT f.rid, f.pos // 2, f.lvl + 1,
    sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.acc ELSE f.acc || coalesce(s.h, '') END)
  FROM top_folds f JOIN top_sizes z ON z.lvl = f.lvl AND z.n > 1
  LEFT JOIN tops s ON s.lvl = f.lvl AND s.pos = xor(f.pos, 1)
), folded AS (
  SELECT rid, max_by(acc, lvl) AS folded_root FROM top_folds GROUP BY rid
)
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, coalesce(f.proof, sha256('')) AS proof_sha256, d.folded_root,
  d.folded_root = t.h AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN tops t ON t.n = 1
LEFT JOIN proof f ON f.rid = p.rid JOIN folded d ON d.rid = p.rid"""
