"""The raw extract built from the driver's test tables (J02, FIXTURES.md section 3).

One ``events`` row is one dial attempt; the customer, nation and first order of
the event's user supply the case attributes. ``event_id`` rides along as the
tie-break for attempts placed in the same second.

Join plan: the customer dimension (customer left-joined to nation and to the
first order date per customer) is built at customer grain, so ``orders`` is
pre-aggregated before it is joined, and ``events`` meets it in one equi-join on
the customer key. No broadcast hints: the planner broadcasts ``nation`` from its
measured size, and AQE splits a hot customer's partition of ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import ntz_text, r_week
from .extract import conform_extract

# Market segment of the test customers -> model segment letter.
SEGMENT_OF_MKTSEGMENT = {
    "HOUSEHOLD": "A",
    "MACHINERY": "C",
    "FURNITURE": "E",
    "AUTOMOBILE": "I",
    "BUILDING": "Z",
}

# Finish codes given to non-contact events, picked by event_id % 33.
# Items 0-30 are the dialer's raw codes, 31 is a code without category, 32 is missing.
FIXTURE_FINISH_CODES = [
    "NoAnswer", "Voicemail", "Afgehandeld", "Terugbellen", "No Circuit", "System Hang Up",
    "GeenGehoor", "Bel Later Terug", "Unassigned Number (ISDN Cause Code 01)",
    "No User Responding (ISDN Cause Code 18)", "Busy", "InGesprek", "Bad Number",
    "No Route To Destination (ISDN Cause Code 03)", "Reorder",
    "Call Rejected (ISDN Cause Code 21)", "NotReached", "Policy Scheduled",
    "Invalid Number Format (ISDN Cause Code 28)", "Normal, Specified (ISDN Cause Code 31)",
    "Ineffective Other", "Remote Hang Up", "NoLines", "Agent not available for callback",
    "Recovery On Timer Expiry (ISDN Cause Code 102)", "Vacant Code",
    "User Alerting No Answer (ISDN Cause Code 19)", "Number Changed (ISDN Cause Code 22)",
    "Failed to route call to agent.", "Incoming Calls Barred Within CUG (ISDN Cause Code 55)",
    "Agent Logout", "Onbekend", None,
]

# Declared read schemas (the columns used): no schema-inference job per read,
# and a changed file type fails loudly instead of flowing through.
TABLE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "orders": "o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def customer_dimension(spark: SparkSession, sf_dir: str, min_acctbal=None) -> DataFrame:
    """One row per customer: segment, nation name, first order date."""
    customer = _table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    if min_acctbal is not None:
        customer = customer.where(F.col("c_acctbal") >= F.lit(min_acctbal))
    # keyed lookup: one name per nation key, so the optimizer can drop the join
    # from reports that never read the subscription column
    nation = (_table(spark, sf_dir, "nation").groupBy("n_nationkey")
              .agg(F.min("n_name").alias("n_name")))
    first_order = (_table(spark, sf_dir, "orders")
                   .groupBy("o_custkey")
                   .agg(F.min("o_orderdate").alias("first_order_date")))
    return (customer
            .join(nation, customer.c_nationkey == nation.n_nationkey, "left")
            .join(first_order, customer.c_custkey == first_order.o_custkey, "left")
            .select("c_custkey", "c_mktsegment", "n_name", "first_order_date"))


def raw_extract(spark: SparkSession, sf_dir: str, min_acctbal=None,
                with_length: bool = True) -> DataFrame:
    """The 14-column raw extract plus ``event_id``.

    ``min_acctbal`` restricts customers (the second, older extract of P04 uses
    ``0``); ``with_length=False`` leaves ``LENGTH`` out as that extract does.
    """
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    dim = customer_dimension(spark, sf_dir, min_acctbal)
    e = events.join(dim, events.user_id == dim.c_custkey, "inner")
    # some customers' attempts fall into the next month, others' all at the start of
    # their week (equal times within a case); some attempts have no time
    monday = F.date_sub(F.to_date("ts"), F.weekday("ts")).cast("timestamp_ntz")
    e = e.withColumn("ts", F.when(F.col("user_id") % 13 == 1, F.col("ts") + F.expr("INTERVAL 31 DAYS"))
                     .when(F.col("user_id") % 10 == 0, monday).otherwise(F.col("ts")))
    week = r_week(F.col("ts"))

    contact = F.col("event_type").isin("click", "purchase")
    seg_pairs = []
    for k, v in SEGMENT_OF_MKTSEGMENT.items():
        seg_pairs += [F.lit(k), F.lit(v)]
    codes = F.array(*[F.lit(c).cast("string") for c in FIXTURE_FINISH_CODES])
    finish = (F.when(F.col("event_type") == "purchase", F.lit("Afgehandeld"))
              .when(F.col("event_type") == "click",
                    F.when(F.col("event_id") % 2 == 0, F.lit("Afgehandeld")).otherwise(F.lit("Terugbellen")))
              .otherwise(F.element_at(codes, (F.col("event_id") % 33 + 1).cast("int"))))

    cols = {
        "CASE_ID_T": F.col("user_id") * 4 + F.col("event_id") % 4,
        "KLANTNR": F.col("user_id"),
        "SEGMENT": F.try_element_at(F.create_map(*seg_pairs), F.col("c_mktsegment")),
        "BATCH_TYPE": F.concat(F.lit("B"), (F.col("user_id") % 3).cast("string")),
        "CUSTOMER_ATT": F.concat(F.lit("ATT"), (F.col("user_id") % 4).cast("string")),
        "CURRENT_SUB": F.col("n_name"),
        "SUB_START_DATE": F.to_date("first_order_date").cast("string"),
        "DATE_OF_BIRTH": F.when(F.col("user_id") % 7 == 0, F.lit("--")).otherwise(F.lit("01-02-1980")),
        "CALLPLACEDTIME": F.when(F.col("event_id") % 97 != 5, ntz_text("ts")),
        "CALLANSWEREDTIME": F.when(contact, ntz_text(F.col("ts") + F.expr("INTERVAL 20 SECONDS"))),
        "ISCONTACT": F.when(contact, F.lit("1")).otherwise(F.lit("0")),
        "IS_SALE": F.when(F.col("event_type") == "purchase", F.lit("1")).otherwise(F.lit("0")),
        "FINISHCODE": finish,
    }
    if with_length:
        # one segment and week in which a category lacks its talk time, one without any talk
        missing = (F.col("c_mktsegment") == "HOUSEHOLD") & (week == 3) & finish.isin("Busy", "InGesprek")
        zero = (F.col("c_mktsegment") == "FURNITURE") & (week == 4)
        cols["LENGTH"] = (F.when(missing, F.lit(None)).when(zero, F.lit(0))
                          .otherwise(F.floor("value")).cast("bigint"))
    out = e.select(*[c.alias(n) for n, c in cols.items()], "event_id")
    return conform_extract(out, keep=("event_id",))
