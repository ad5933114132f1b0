"""Run the whole report pack on an extract and write every report.

    python -m dialmetrics.plans.runner --sql extract.sql --out /shared/reports
    python -m dialmetrics.plans.runner --parquet /shared/extract --store /shared/attempts --out ...
    python -m dialmetrics.plans.runner --parquet /shared/2018-03-12 --grow /shared/growing --load 2018-03-12 --out ...
    python -m dialmetrics.plans.runner --tables /root/testdata/sf0.01 --params fixture --out ...
    python -m dialmetrics.plans.runner --views /root/testdata/sf0.01 --sql examples/fixture_extract.sql \
        --params fixture --out ...

The extract is derived once (and, with ``--store``, landed partitioned by date
and read back; with ``--grow``, appended to a growing store as one load), then each report is written to ``<out>/<report name>`` as CSV
(header, missing as ``NA``) or parquet. Report names are those of ``REPORTS``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ..operators.derive import derive_attempts
from ..operators.losses import loss_report
from ..params import FIXTURE, REFERENCE, Params
from ..session import with_profile
from ..sources.extract import load_extract_jdbc, load_extract_parquet, load_extract_sql, read_sql_file
from ..sources.fixture import raw_extract
from ..sources.growing import BUCKETS, append_load, create_store, has_store, load_losses, read_grown
from ..sources.sinks import write_report
from ..sources.store import read_attempts, write_attempts
from .lattice import Lattice
from .registry import REPORTS
from .reports import shared_aggregates


def run_all(attempts: DataFrame, params: Params, out_root: str, fmt: str = "csv",
            older: DataFrame | None = None, names=None) -> list[str]:
    """Write every report (or ``names``) computed from ``attempts``.

    ``older`` is the second extract's attempts table for P04 and the difference to it;
    without it those reports are skipped. Additive reports share bases (lattice.py); these and other shared
    aggregates are cached for this run only.
    """
    written = []
    chosen = [n for n in REPORTS if not names or n in names]
    current = [n for n in chosen if REPORTS[n][2] == "current"]
    with shared_aggregates(), Lattice(attempts, current) as bases:
        for name in chosen:
            fn, _numbered, extract = REPORTS[name]
            sources = {"older": [older], "both": [attempts, older]}.get(extract) or [bases.source(name)]
            if any(s is None for s in sources):
                continue
            path = f"{out_root.rstrip('/')}/{name}"
            write_report(fn(*sources, params), path, fmt=fmt)
            written.append(path)
    return written


def register_views(spark: SparkSession, folder: str) -> list[str]:
    """Register every ``<name>.parquet`` in ``folder`` as temporary view ``<name>``.

    The folder is listed by Spark's file system, so it may be on any store.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {s.getPath().getName(): s.getPath().toString() for s in store.listStatus(root)}
    names = []
    for file in sorted(f for f in found if f.endswith(".parquet")):
        name = file[: -len(".parquet")]
        spark.read.parquet(found[file]).createOrReplaceTempView(name)
        names.append(name)
    if not names:
        raise ValueError(f"no <name>.parquet in {folder}")
    return names


def _property(text: str) -> tuple[str, str]:
    name, sep, value = text.partition("=")
    if not sep:
        raise argparse.ArgumentTypeError("NAME=VALUE is needed")
    return name, value


def _load(spark: SparkSession, args, sql: str | None, parquet: str | None) -> DataFrame:
    if args.jdbc_url and sql:
        return load_extract_jdbc(spark, args.jdbc_url, read_sql_file(sql), dict(args.jdbc_property),
                                 one_task=args.one_task,
                                 partition_column=args.partition_column, lower_bound=args.lower_bound,
                                 upper_bound=args.upper_bound, num_partitions=args.num_partitions)
    if sql:
        return load_extract_sql(spark, sql)
    return load_extract_parquet(spark, parquet)


def _attempts(spark: SparkSession, args, params: Params) -> tuple[DataFrame, DataFrame | None]:
    """The attempts and the older extract's; what typing lost is written as report ``parse_losses``."""
    older = None
    losses = f"{args.out.rstrip('/')}/parse_losses"
    if args.older_sql or args.older_parquet:
        older = derive_attempts(_load(spark, args, args.older_sql, args.older_parquet), params)
    if args.tables:
        raw = raw_extract(spark, args.tables)
        older = derive_attempts(raw_extract(spark, args.tables, min_acctbal=0, with_length=False), params)
    else:
        raw = _load(spark, args, args.sql, args.parquet)
    if args.grow:
        if not has_store(spark, args.grow):
            create_store(spark, args.grow, params, args.buckets)
        append_load(raw, args.grow, params, args.load, tuple(args.replaces))
        write_report(load_losses(spark, args.grow), losses, fmt=args.format)
        return read_grown(spark, args.grow, params), older
    if args.store:
        found = write_attempts(derive_attempts(raw, params, losses=True), args.store)
        rows = [(c, *n) for c, n in found.items()]
        write_report(spark.createDataFrame(rows, "variable_name string, texts long, lost long"), losses, fmt=args.format)
        return read_attempts(spark, args.store), older
    if not args.report:     # nothing is landed: counted by an aggregation of its own
        write_report(loss_report(raw), losses, fmt=args.format)
    return derive_attempts(raw, params), older


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--sql", help="extract query (.sql file) run by spark.sql, or by JDBC with --jdbc-url")
    src.add_argument("--parquet", help="extract landed as parquet")
    src.add_argument("--tables", help="folder with the test tables (events, customer, nation, orders)")
    ap.add_argument("--older-sql", help="the second, older extract (P04), as SQL")
    ap.add_argument("--older-parquet", help="the second, older extract (P04), as parquet")
    ap.add_argument("--views", help="register each <name>.parquet of this folder as view <name> first")
    ap.add_argument("--jdbc-url")
    ap.add_argument("--jdbc-property", action="append", default=[], metavar="NAME=VALUE", type=_property,
                    help="reader option: user, password, driver (repeatable)")
    ap.add_argument("--one-task", action="store_true", help="read a small extract over JDBC in one task")
    ap.add_argument("--partition-column")
    ap.add_argument("--lower-bound")
    ap.add_argument("--upper-bound")
    ap.add_argument("--num-partitions", type=int)
    ap.add_argument("--params", choices=["reference", "fixture"], default="reference")
    ap.add_argument("--set", action="append", default=[], metavar="NAME=VALUE",
                    help="override a report parameter, e.g. --set cut=2018-03-12 --set months=2,3,4")
    ap.add_argument("--store", help="land the attempts table here first and read it back")
    ap.add_argument("--grow", help="append the extract to this growing store and report on all of it")
    ap.add_argument("--load", help="the load's name in the growing store; a name that it holds is not loaded again")
    ap.add_argument("--replaces", action="append", default=[], metavar="DAY",
                    help="a day (yyyy-mm-dd) whose earlier rows the load replaces (repeatable)")
    ap.add_argument("--buckets", type=int, default=BUCKETS, help="buckets of cases of a new growing store")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", choices=["csv", "parquet"], default="csv")
    ap.add_argument("--report", action="append", help="only these reports (repeatable)")
    args = ap.parse_args(argv)
    if args.grow and (not args.load or args.store):
        ap.error("--grow needs --load, and no --store")
    if args.jdbc_url and not args.sql:
        ap.error("--jdbc-url needs --sql")
    if args.jdbc_url and not args.one_task and None in (
            args.partition_column, args.lower_bound, args.upper_bound, args.num_partitions):
        ap.error("--jdbc-url needs --partition-column, --lower-bound, --upper-bound and "
                 "--num-partitions, or --one-task for a small extract")

    spark = with_profile(SparkSession.builder.appName("dialmetrics-reports").getOrCreate())
    if args.views:
        register_views(spark, args.views)
    params = (FIXTURE if args.params == "fixture" else REFERENCE).with_text(args.set)
    if args.store or args.grow:
        params = params.with_(renumber_first_attempts=False)  # attempt_no is materialised
    attempts, older = _attempts(spark, args, params)
    for p in run_all(attempts, params, args.out, args.format, older, args.report):
        print(p)


if __name__ == "__main__":
    main()
