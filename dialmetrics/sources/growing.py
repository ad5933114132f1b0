"""An attempts store that grows by loads and never renumbers what it holds.

The original loads its extract anew for each run. Here a load (a day, say) is
appended, and the attempt number (W01) is put together when it is read:

``rows/load=<v>/placed_date=<d>``
    the typed attempts of a load, without a number; never rewritten
``hours/load=<v>/bucket=<b>``
    attempts per (case, hour) and how many of the case came before that hour
    (``numbering.with_before``), by buckets of cases
``snapshots/<v>.json``
    what is valid after load ``v``: the loads, the version of each bucket, and
    the rules under which the rows were derived

A load counts its own rows per (case, hour), reads the count rows of the buckets
its cases fall into, adds both up, and writes those buckets' offsets as a new
version: a late attempt moves the offsets of its case's later hours, and no
attempt is read or written again. Reading the numbered table scans the rows once
and joins the stored offsets; the hour an attempt falls into is numbered in the
window that shares the join's partitioning.

A load may replace whole days (``replaces``): their earlier rows stop being valid
and their counts are taken off; the files of other days stay as they are.

Rules. ``dialer_tweak`` and ``pilot_cat`` are stored with the rows, so the store
keeps the cut and the control segments they were derived by, and reading or
loading with others raises.

Lost executors and drivers. A load becomes valid with its snapshot, one small
file that is renamed into place: what a failed load left behind is written over
by the next one. A load that is repeated under its name does nothing. Of two
loads at the same time one fails. To the driver come the snapshot (a number for
each bucket) and the numbers of a load's buckets.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.derive import ATTEMPT_COLUMNS, type_and_derive
from ..operators.losses import LOST
from ..operators.numbering import SLOT_KEYS, count_slots, number_attempts, with_before
from ..params import Params
from .extract import RAW_SCHEMA, conform_extract
from .store import ATTEMPTS_SCHEMA, write_attempts

RULES_VERSION = 1           # of the row-wise derivation; another one cannot be mixed into a store
BUCKETS = 64                # of cases
ROWS_SCHEMA = T.StructType([f for f in ATTEMPTS_SCHEMA.fields if f.name != "attempt_no"]
                           + [T.StructField("load", T.IntegerType())])
LANDED_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField("event_id", T.LongType())])
HOURS_SCHEMA = "_dm_case long, _dm_none boolean, _dm_late boolean, _dm_slot long, _dm_n long, _dm_before long, load int, bucket int"


@dataclass(frozen=True)
class Snapshot:
    cut: str
    control_segments: tuple
    rules: int
    versions: tuple         # by bucket: the load that wrote its offsets, 0 for none
    loads: tuple = ()       # (load, name, days that a later load replaced, (column, texts, lost) of its typing)

    @property
    def version(self) -> int:
        return len(self.loads)

    def check(self, params: Params) -> None:
        mine, theirs = (self.cut, self.control_segments, self.rules), (params.cut, tuple(params.control_segments), RULES_VERSION)
        if mine != theirs:
            raise ValueError(f"the store was derived by (cut, control segments, rules) {mine}, not {theirs}")


# ---- snapshots

def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, path: str, snap: Snapshot) -> None:
    text = json.dumps({"cut": snap.cut, "control_segments": snap.control_segments, "rules": snap.rules,
                       "versions": snap.versions, "loads": snap.loads})
    jvm, folder, store = _files(spark, f"{path}/snapshots")
    final, draft = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f"{snap.version:08d}.json", f"_{snap.version:08d}.json"))
    if store.exists(final):
        raise RuntimeError(f"load {snap.version} was published by another job")
    out = store.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not store.rename(draft, final):
        raise RuntimeError(f"load {snap.version} was published by another job")


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The latest snapshot of the store."""
    _, folder, store = _files(spark, f"{path}/snapshots")
    names = sorted(s.getPath().toString() for s in store.listStatus(folder) if not s.getPath().getName().startswith("_"))
    held = json.loads(spark.read.text(names[-1], wholetext=True).first()[0])
    return Snapshot(held["cut"], tuple(held["control_segments"]), held["rules"], tuple(held["versions"]),
                    tuple((v, n, tuple(d), tuple(map(tuple, x))) for v, n, d, x in held["loads"]))


def load_names(spark: SparkSession, path: str) -> list[str]:
    return [n for _, n, *_ in snapshot(spark, path).loads]


def load_losses(spark: SparkSession, path: str) -> DataFrame:
    """``load, variable_name, texts, lost``: what typing lost in each load."""
    rows = [(n, *x) for _, n, _, found in snapshot(spark, path).loads for x in found]
    return spark.createDataFrame(rows, "load string, variable_name string, texts long, lost long")


def has_store(spark: SparkSession, path: str) -> bool:
    _, folder, store = _files(spark, f"{path}/snapshots")
    return store.exists(folder)


def create_store(spark: SparkSession, path: str, params: Params, buckets: int = BUCKETS) -> Snapshot:
    """An empty store; ``buckets`` as many as keep a bucket's (case, hour) rows in a few files."""
    snap = Snapshot(params.cut, tuple(params.control_segments), RULES_VERSION, (0,) * buckets)
    _publish(spark, path, snap)
    return snap


# ---- reading

def _rows(spark: SparkSession, path: str, snap: Snapshot) -> DataFrame:
    folders = [f"{path}/rows/load={v}" for v, *_ in snap.loads]
    if not folders:
        return spark.createDataFrame([], ROWS_SCHEMA)
    df = spark.read.schema(ROWS_SCHEMA).option("basePath", f"{path}/rows").parquet(*folders)
    for v, _, days, _ in snap.loads:    # partition filters
        if days:
            gone = (F.col("load") == v) & F.col("placed_date").isin(*[F.lit(d).cast("date") for d in days])
            df = df.where(~F.coalesce(gone, F.lit(False)))
    return df


def _hours(spark: SparkSession, path: str, snap: Snapshot, buckets: Sequence[int] | None = None) -> DataFrame:
    """The count rows of the buckets (all), in their valid versions."""
    chosen = range(len(snap.versions)) if buckets is None else buckets
    folders = [f"{path}/hours/load={snap.versions[b]}/bucket={b}" for b in chosen if snap.versions[b]]
    if not folders:
        return spark.createDataFrame([], HOURS_SCHEMA)
    return spark.read.schema(HOURS_SCHEMA).option("basePath", f"{path}/hours").parquet(*folders)


def read_grown(spark: SparkSession, path: str, params: Params, numbered: bool = True) -> DataFrame:
    """The attempts of all loads; ``numbered=False`` for reports that do not read the number."""
    snap = snapshot(spark, path)
    snap.check(params)
    df = _rows(spark, path, snap).drop("load")
    if numbered:
        df = number_attempts(df, offsets=_hours(spark, path, snap))
    else:
        df = df.withColumn("attempt_no", F.lit(None).cast("int"))
    return df.select(*ATTEMPT_COLUMNS, "event_id")


# ---- loading

def append_load(raw: DataFrame, path: str, params: Params, name: str, replaces: Sequence[str] = ()) -> Snapshot:
    """Append a raw extract as one load; ``replaces`` names days (``yyyy-mm-dd``) whose earlier rows it stands for.

    A load whose name the store holds already is not loaded again.
    """
    spark = raw.sparkSession
    snap = snapshot(spark, path)
    snap.check(params)
    if any(n == name for _, n, *_ in snap.loads):
        return snap
    v, buckets = snap.version + 1, len(snap.versions)
    typed = type_and_derive(conform_extract(raw), params, losses=True)
    if "event_id" not in typed.columns:
        typed = typed.withColumn("event_id", F.lit(None).cast("long"))
    own = [f.name for f in ROWS_SCHEMA.fields if f.name != "load"]
    lost = write_attempts(typed.select(*own, LOST), f"{path}/rows/load={v}")
    days = tuple(sorted(replaces))
    landed = _rows(spark, path, replace(snap, loads=((v, name, (), ()),)))      # as stored: later steps see the same rows
    added = count_slots(landed.where(F.col("placed_time").isNotNull()))
    if days:
        stale = _rows(spark, path, snap).where(F.col("placed_date").isin(*[F.lit(d).cast("date") for d in days]))
        added = added.unionByName(count_slots(stale).withColumn("_dm_n", -F.col("_dm_n")))
    in_bucket = F.pmod(F.xxhash64("_dm_case", "_dm_none"), F.lit(buckets)).cast("int")
    added = added.withColumn("bucket", in_bucket)
    touched = sorted(r.bucket for r in added.select("bucket").distinct().collect())       # at most ``buckets``
    held = _hours(spark, path, snap, touched).select(*SLOT_KEYS, "_dm_n", "bucket")
    # one shuffle by bucket serves the sums, the offsets and the files (one for each bucket)
    counts = (held.unionByName(added.select(*SLOT_KEYS, "_dm_n", "bucket")).repartition("bucket")
              .groupBy("bucket", *SLOT_KEYS).agg(F.sum("_dm_n").alias("_dm_n")).where(F.col("_dm_n") > 0))
    (with_before(counts, "bucket").sortWithinPartitions("bucket", *SLOT_KEYS)
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/hours/load={v}"))
    kept = {r.bucket for r in spark.read.schema(HOURS_SCHEMA).option("basePath", f"{path}/hours")
            .parquet(f"{path}/hours/load={v}").select("bucket").distinct().collect()}
    versions = tuple((v if b in kept else 0) if b in set(touched) else old for b, old in enumerate(snap.versions))
    earlier = tuple((n, label, tuple(sorted({*gone, *days})), x) for n, label, gone, x in snap.loads)
    grown = replace(snap, versions=versions, loads=(*earlier, (v, name, (), tuple((c, *n) for c, n in lost.items()))))
    _publish(spark, path, grown)
    return grown


def append_landed(spark: SparkSession, folder: str, path: str, params: Params, fmt: str = "parquet") -> list[str]:
    """Append what has landed in ``folder`` since the last call, oldest name first; returns the names.

    Each file or sub-folder there is a load of its own, named after it, so the snapshots say
    what is in: a call that is repeated, or was lost half way, goes on with what is missing.
    Names that start with ``_`` or ``.`` are not landed yet.
    """
    _, root, store = _files(spark, folder)
    found = {s.getPath().getName(): s.getPath().toString() for s in store.listStatus(root)}
    held = set(load_names(spark, path))
    new = sorted(n for n in found if n not in held and n[0] not in "_.")
    for name in new:
        append_load(spark.read.schema(LANDED_SCHEMA).format(fmt).load(found[name]), path, params, name)
    return new
