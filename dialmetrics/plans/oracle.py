"""Independent DuckDB statement of every report, for the correctness check.

Written directly in SQL against the raw test tables (``events customer nation
orders``), not generated from the Spark code: the finish-code rules below are
spelled out as CASE expressions (fixed values, in the dialer's list order). Shared rules, in DuckDB terms:

* R sum: missing when any value is missing -> ``CASE WHEN count(x) = count(*)``
* R distinct count: null counts as a value -> ``count(DISTINCT x) + max(x IS NULL)``
* division: DuckDB double division already gives inf / nan on a zero divisor
* rounding: half-even -> ``round_even(x * 100, 0) / 100``
* shares of 2-decimal values are taken over whole hundredths
"""

from __future__ import annotations

from ..params import FIXTURE, Params
from ..sources.dictionary import DESCRIPTIONS, VALUE_COLUMNS

# Finish codes of the fixture's non-contact events (event_id % 33; item 32 missing).
_FIXTURE_CODES_SQL = (
    "['NoAnswer', 'Voicemail', 'Afgehandeld', 'Terugbellen', 'No Circuit', 'System Hang Up', "
    "'GeenGehoor', 'Bel Later Terug', 'Unassigned Number (ISDN Cause Code 01)', "
    "'No User Responding (ISDN Cause Code 18)', 'Busy', 'InGesprek', 'Bad Number', "
    "'No Route To Destination (ISDN Cause Code 03)', 'Reorder', "
    "'Call Rejected (ISDN Cause Code 21)', 'NotReached', 'Policy Scheduled', "
    "'Invalid Number Format (ISDN Cause Code 28)', 'Normal, Specified (ISDN Cause Code 31)', "
    "'Ineffective Other', 'Remote Hang Up', 'NoLines', 'Agent not available for callback', "
    "'Recovery On Timer Expiry (ISDN Cause Code 102)', 'Vacant Code', "
    "'User Alerting No Answer (ISDN Cause Code 19)', 'Number Changed (ISDN Cause Code 22)', "
    "'Failed to route call to agent.', 'Incoming Calls Barred Within CUG (ISDN Cause Code 55)', "
    "'Agent Logout', 'Onbekend', NULL]"
)

_RESULT2_SQL = """CASE result
      WHEN 'Unassigned Number (ISDN Cause Code 01)' THEN 'Unassigned Number'
      WHEN 'No Route To Destination (ISDN Cause Code 03)' THEN 'No Route To Destination'
      WHEN 'User Alerting No Answer (ISDN Cause Code 19)' THEN 'User Alerting No Answer'
      WHEN 'Incoming Calls Barred Within CUG (ISDN Cause Code 55)' THEN 'Incoming Calls Barred Within CUG'
      WHEN 'No User Responding (ISDN Cause Code 18)' THEN 'No User Responding'
      WHEN 'Call Rejected (ISDN Cause Code 21)' THEN 'Call Rejected'
      WHEN 'Invalid Number Format (ISDN Cause Code 28)' THEN 'Invalid Number Format'
      WHEN 'Normal, Specified (ISDN Cause Code 31)' THEN 'Normal, Specified'
      WHEN 'Recovery On Timer Expiry (ISDN Cause Code 102)' THEN 'Recovery On Timer Expiry'
      WHEN 'Number Changed (ISDN Cause Code 22)' THEN 'Number Changed'
      ELSE result END"""

_RESULT_CAT_SQL = """CASE result2
      WHEN 'NoAnswer' THEN 'No answer'
      WHEN 'Voicemail' THEN 'Voicemail'
      WHEN 'Afgehandeld' THEN 'Effective'
      WHEN 'Terugbellen' THEN 'Call back'
      WHEN 'No Circuit' THEN 'Technical'
      WHEN 'System Hang Up' THEN 'Technical'
      WHEN 'GeenGehoor' THEN 'No answer'
      WHEN 'Bel Later Terug' THEN 'Call back'
      WHEN 'Unassigned Number' THEN 'Bad number'
      WHEN 'No User Responding' THEN 'No answer'
      WHEN 'Busy' THEN 'Busy'
      WHEN 'InGesprek' THEN 'Busy'
      WHEN 'Bad Number' THEN 'Bad number'
      WHEN 'No Route To Destination' THEN 'Technical'
      WHEN 'Reorder' THEN 'Technical'
      WHEN 'Call Rejected' THEN 'Technical'
      WHEN 'NotReached' THEN 'No answer'
      WHEN 'Policy Scheduled' THEN 'Call back'
      WHEN 'Invalid Number Format' THEN 'Bad number'
      WHEN 'Normal, Specified' THEN 'Technical'
      WHEN 'Ineffective Other' THEN 'Technical'
      WHEN 'Remote Hang Up' THEN 'Technical'
      WHEN 'NoLines' THEN 'Technical'
      WHEN 'Agent not available for callback' THEN 'Technical'
      WHEN 'Recovery On Timer Expiry' THEN 'Technical'
      WHEN 'Vacant Code' THEN 'Technical'
      WHEN 'User Alerting No Answer' THEN 'Technical'
      WHEN 'Number Changed' THEN 'Bad number'
      WHEN 'Failed to route call to agent.' THEN 'Technical'
      WHEN 'Incoming Calls Barred Within CUG' THEN 'Technical'
      WHEN 'Agent Logout' THEN 'Technical'
      END"""


def _base(p: Params, older: bool = False) -> str:
    acct = "WHERE c.c_acctbal >= 0" if older else ""
    length = "CAST(NULL AS BIGINT)" if older else """CASE
      WHEN c.c_mktsegment = 'HOUSEHOLD' AND (dayofyear(e.at) - 1) // 7 + 1 = 3
        AND e.event_type NOT IN ('purchase', 'click') AND e.event_id % 33 IN (10, 11) THEN NULL
      WHEN c.c_mktsegment = 'FURNITURE' AND (dayofyear(e.at) - 1) // 7 + 1 = 4 THEN 0
      ELSE CAST(floor(e.value) AS BIGINT) END"""
    control = ", ".join(f"'{s}'" for s in p.control_segments)
    ts_fmt = "'%Y-%m-%d %H:%M:%S'"
    return f"""
first_order AS (
  SELECT o_custkey, min(o_orderdate) AS first_order_date FROM orders GROUP BY o_custkey
),
cust AS (
  SELECT c.c_custkey, c.c_mktsegment, n.n_name, f.first_order_date
  FROM customer c
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN first_order f ON f.o_custkey = c.c_custkey
  {acct}
),
raw AS (
  SELECT
    e.user_id * 4 + e.event_id % 4 AS CASE_ID_T,
    e.user_id AS KLANTNR,
    CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'A' WHEN 'MACHINERY' THEN 'C'
      WHEN 'FURNITURE' THEN 'E' WHEN 'AUTOMOBILE' THEN 'I' WHEN 'BUILDING' THEN 'Z' END AS SEGMENT,
    'B' || CAST(e.user_id % 3 AS VARCHAR) AS BATCH_TYPE,
    'ATT' || CAST(e.user_id % 4 AS VARCHAR) AS CUSTOMER_ATT,
    c.n_name AS CURRENT_SUB,
    strftime(c.first_order_date, '%Y-%m-%d') AS SUB_START_DATE,
    CASE WHEN e.user_id % 7 = 0 THEN '--' ELSE '01-02-1980' END AS DATE_OF_BIRTH,
    CASE WHEN e.event_id % 97 <> 5 THEN strftime(e.at, {ts_fmt}) END AS CALLPLACEDTIME,
    CASE WHEN e.event_type IN ('click', 'purchase')
      THEN strftime(e.at + INTERVAL 20 SECOND, {ts_fmt}) END AS CALLANSWEREDTIME,
    {length} AS LENGTH,
    CASE WHEN e.event_type IN ('click', 'purchase') THEN '1' ELSE '0' END AS ISCONTACT,
    CASE WHEN e.event_type = 'purchase' THEN '1' ELSE '0' END AS IS_SALE,
    CASE WHEN e.event_type = 'purchase' THEN 'Afgehandeld'
         WHEN e.event_type = 'click' THEN
           CASE WHEN e.event_id % 2 = 0 THEN 'Afgehandeld' ELSE 'Terugbellen' END
         ELSE ({_FIXTURE_CODES_SQL})[e.event_id % 33 + 1] END AS FINISHCODE,
    e.event_id
  FROM (SELECT *, CASE WHEN user_id % 13 = 1 THEN ts + INTERVAL 31 DAY
          WHEN user_id % 10 = 0 THEN CAST(date_trunc('week', ts) AS TIMESTAMP) ELSE ts END AS at
        FROM events) e JOIN cust c ON c.c_custkey = e.user_id
),
typed AS (
  SELECT
    CASE_ID_T AS id, KLANTNR AS customer, SEGMENT AS segs, BATCH_TYPE AS batch,
    CUSTOMER_ATT AS customer_att, CURRENT_SUB AS sub,
    CAST(COALESCE(try_strptime(SUB_START_DATE, '%Y-%m-%d'), try_strptime(SUB_START_DATE, '%Y/%m/%d'),
                  try_strptime(SUB_START_DATE, '%Y%m%d')) AS DATE) AS sub_start_date,
    DATE_OF_BIRTH AS date_of_birth,
    try_strptime(CALLPLACEDTIME, {ts_fmt}) AS placed_time,
    try_strptime(CALLANSWEREDTIME, {ts_fmt}) AS answered_time,
    LENGTH AS length,
    TRY_CAST(trunc(TRY_CAST(ISCONTACT AS DOUBLE)) AS INTEGER) AS is_contact,
    TRY_CAST(trunc(TRY_CAST(IS_SALE AS DOUBLE)) AS INTEGER) AS is_sale,
    FINISHCODE AS result,
    event_id
  FROM raw
),
derived AS (
  SELECT *,
    CAST(placed_time AS DATE) AS placed_date,
    CAST((dayofyear(placed_time) - 1) // 7 + 1 AS INTEGER) AS placed_week,
    CAST(month(placed_time) AS INTEGER) AS placed_month,
    strftime(placed_time, '%H:%M:%S') AS placed_moment,
    CAST(hour(placed_time) AS INTEGER) AS placed_hour,
    CASE WHEN segs IS NULL THEN 'error' WHEN segs IN ({control}) THEN 'control' ELSE 'trial' END AS pilot_cat,
    {_RESULT2_SQL} AS result2
  FROM typed
),
derived2 AS (
  SELECT *,
    CASE WHEN placed_date IS NULL THEN 'error' WHEN placed_date < DATE '{p.cut}' THEN 'no tweak'
         ELSE 'tweak' END AS dialer_tweak,
    {_RESULT_CAT_SQL} AS result_cat,
    CASE WHEN placed_time IS NOT NULL THEN CAST(row_number() OVER (
      PARTITION BY id ORDER BY placed_time NULLS LAST, event_id) AS INTEGER) END AS attempt_no
  FROM derived
),
attempts AS (
  SELECT id, customer, segs, batch, customer_att, sub, sub_start_date, date_of_birth,
    placed_time, answered_time, length, is_contact, is_sale, result, placed_date, placed_week,
    placed_month, placed_moment, placed_hour, dialer_tweak, pilot_cat, result2, result_cat,
    attempt_no, event_id
  FROM derived2
)"""


def _rsum(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN CAST(sum({x}) AS BIGINT) END"


def _ndist(x: str) -> str:
    return f"(count(DISTINCT {x}) + max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END))"


def _ratio(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE))"


def _r(x: str, k: int = 2) -> str:
    return f"(round_even(({x}) * {10 ** k}, 0) / {10 ** k})"


def _h(x: str) -> str:
    """A 2-decimal value as whole hundredths (a double: zero hours give NaN)."""
    return f"round_even(({x}) * 100, 0)"


def _rsum_over(x: str, w: str) -> str:
    """R sum over a window: missing when one of the values is."""
    return f"(CASE WHEN count({x}) OVER {w} = count(*) OVER {w} THEN sum({x}) OVER {w} END)"


def _q(ctes: list[tuple[str, str]], final: str, p: Params, older: bool = False) -> str:
    extra = "".join(f",\n{name} AS (\n{body}\n)" for name, body in ctes)
    return f"WITH {_base(p, older)}{extra}\n{final}"


def _benefit(keys: list[str], where: str = "TRUE") -> str:
    k = ", ".join(keys)
    sk = f"{k}, " if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    return f"""SELECT {sk}records, attempts, contacts, sales,
  {_r(_ratio('sales', 'records') + ' * 100')} AS conversion,
  {_r(_ratio('sales', 'attempts') + ' * 100')} AS sales_to_dials,
  {_r(_ratio('sales', 'contacts') + ' * 100')} AS sales_to_connects,
  {_r(_ratio('attempts', 'records'))} AS avg_dials
FROM (SELECT {sk}{_ndist('id')} AS records, count(*) AS attempts,
        {_rsum('is_contact')} AS contacts, {_rsum('is_sale')} AS sales
      FROM attempts WHERE {where} {grp}) agg"""


def _long(src: str, keep: list[str], cols: list[str], key: str, value: str) -> str:
    k = ", ".join(keep)
    return "\nUNION ALL\n".join(f"SELECT {k}, '{c}' AS {key}, {c} AS {value} FROM {src}" for c in cols)


def _wide(src: str, rest: list[str], key: str, value: str, values, quote: bool) -> str:
    cells = ",\n  ".join(
        f"max(CASE WHEN {key} = {repr(str(v)) if quote else v} THEN {value} END) AS \"{v}\"" for v in values)
    r = ", ".join(rest)
    return f"SELECT {r},\n  {cells}\nFROM {src} GROUP BY {r}"


TWEAK = "dialer_tweak = 'tweak'"
RATIOS = ["conversion", "sales_to_dials", "sales_to_connects", "avg_dials"]


def oracle_sql(p: Params = FIXTURE) -> dict[str, str]:
    if p.week_columns is None or p.hour_columns is None:
        raise ValueError("the oracle needs fixed wide columns: set week_columns and hour_columns")
    segs_in = ", ".join(f"'{s}'" for s in p.segments)
    weeks_above = [w for w in p.week_columns if w > p.week_floor]
    week_txt = sorted(str(w) for w in p.week_columns)
    hour_txt = sorted(str(h) for h in p.hour_columns)
    months = ", ".join(str(m) for m in p.months)
    left_out = ", ".join(f"'{h}'" for h in p.hours_left_out)
    q: dict[str, str] = {}

    q["attempts"] = _q([], "SELECT * FROM attempts", p)
    q["attempts_from_loads"] = q["attempts"]
    q["extremes"] = _q([], f"""SELECT segs, id, count(*) AS attempts FROM attempts
GROUP BY segs, id HAVING count(*) > {p.extreme_attempts}""", p)
    q["benefit_segs"] = _q([], _benefit(["segs"]), p)

    def segs_weeks(older: bool) -> str:
        return _q([
            ("b", _benefit(["segs", "placed_week"], f"placed_week > {p.week_floor} AND segs IN ({segs_in})")),
            ("l", _long("b", ["segs", "placed_week"], RATIOS, "key", "value")),
        ], _wide("l", ["segs", "key"], "placed_week", "value", weeks_above, quote=False), p, older)

    q["benefit_segs_weeks"] = segs_weeks(False)
    q["benefit_segs_weeks_v1"] = segs_weeks(True)

    def segs_weeks_long(older: bool) -> str:
        return _q([("b", _benefit(["segs", "placed_week"], f"placed_week > {p.week_floor} AND segs IN ({segs_in})"))],
                  _long("b", ["segs", "placed_week"], RATIOS, "key", "value"), p, older)

    q["benefit_segs_weeks_diff"] = f"""WITH c AS ({segs_weeks_long(False)}), o AS ({segs_weeks_long(True)})
SELECT coalesce(c.segs, o.segs) AS segs, coalesce(c.placed_week, o.placed_week) AS placed_week,
  coalesce(c.key, o.key) AS key, c.value AS current, o.value AS older, c.value - o.value AS delta,
  CASE WHEN o.key IS NULL THEN 'only current' WHEN c.key IS NULL THEN 'only older'
    WHEN c.value IS NOT DISTINCT FROM o.value THEN 'same' ELSE 'changed' END AS status
FROM c FULL OUTER JOIN o ON c.segs IS NOT DISTINCT FROM o.segs
  AND c.placed_week IS NOT DISTINCT FROM o.placed_week AND c.key = o.key"""
    q["benefit_cat"] = _q([], _benefit(["pilot_cat"]), p)
    q["benefit_total"] = _q([], _benefit([]), p)
    q["benefit_case"] = _q([], _benefit(["id"]), p)
    q["benefit_segs_week_long"] = _q(
        [("b", _benefit(["segs", "placed_week", "dialer_tweak"], TWEAK))],
        _long("b", ["segs", "placed_week", "dialer_tweak", "records", "attempts", "contacts", "sales"],
              RATIOS, "metric", "value"), p)
    q["benefit_cat_week_long"] = _q(
        [("b", _benefit(["pilot_cat", "placed_week"], TWEAK))],
        _long("b", ["pilot_cat", "placed_week", "records", "attempts", "contacts", "sales"],
              RATIOS, "metric", "value"), p)
    q["benefit_week_long"] = _q(
        [("b", _benefit(["placed_week"], TWEAK))],
        _long("b", ["placed_week", "records", "attempts", "contacts", "sales", "conversion"],
              ["sales_to_dials", "sales_to_connects", "avg_dials"], "metric", "value"), p)

    def counts(keys: list[str], where: str, name: str) -> str:
        k = ", ".join(keys)
        return _q([], f"SELECT {k}, count(*) AS {name} FROM attempts WHERE {where} GROUP BY {k}", p)

    q["dials_by_date"] = counts(["placed_date"], TWEAK, "attempts")
    q["dials_by_date_segs"] = counts(["placed_date", "segs"], TWEAK, "attempts")
    q["dials_by_contact"] = counts(["placed_date", "segs", "is_contact"], TWEAK, "attempts")
    q["contacts_by_sale"] = counts(["placed_date", "segs", "is_sale", "pilot_cat"],
                                   f"is_contact = 1 AND {TWEAK}", "attempts")
    q["sales_by_pilot"] = counts(["placed_date", "segs", "pilot_cat", "dialer_tweak"], "is_sale = 1", "sales")

    hour_ctes = [
        ("h", f"""SELECT placed_hour, count(*) AS attempts, {_rsum('is_contact')} AS contacts,
  {_rsum('is_sale')} AS sales FROM attempts WHERE {TWEAK} GROUP BY placed_hour"""),
        ("hr", f"""SELECT placed_hour, attempts, contacts, sales,
  {_ratio('attempts', 'sum(attempts) OVER ()')} AS attempt_perc,
  {_ratio('contacts', 'attempts')} AS contact_perc,
  {_ratio('sales', 'contacts')} AS sales_perc FROM h"""),
    ]
    q["hour_rates"] = _q(hour_ctes, "SELECT * FROM hr", p)
    q["hour_rates_long"] = _q(hour_ctes, _long(
        "hr", ["placed_hour", "attempts", "contacts", "sales"],
        ["attempt_perc", "contact_perc", "sales_perc"], "key", "value"), p)

    def chosen(ids) -> str:
        return "TRUE" if ids is None else f"id IN ({', '.join(str(i) for i in ids)})"

    for name, ids in (("case_history", p.case_id), ("case_history_shared", p.shared_case_id)):
        q[name] = _q([], f"""SELECT * EXCLUDE (attempt_no),
  CAST(row_number() OVER (PARTITION BY id ORDER BY placed_time NULLS LAST, event_id) AS INTEGER) AS attempt_no
FROM attempts WHERE {chosen(ids)}""", p)
    q["cases_history"] = _q([], f"""SELECT * EXCLUDE (attempt_no),
  CASE WHEN placed_time IS NOT NULL THEN CAST(row_number() OVER (
    PARTITION BY id ORDER BY placed_time NULLS LAST, event_id) AS INTEGER) END AS attempt_no
FROM attempts WHERE {chosen(p.case_ids)}""", p)

    first_k = f"attempt_no < {p.attempt_cap} AND {TWEAK}"
    q["attempt_dist"] = _q([], f"""SELECT attempt_no, segs, {_ndist('id')} AS number
FROM attempts WHERE {first_k} GROUP BY attempt_no, segs""", p)

    def rates(scale: str) -> list[tuple[str, str]]:
        return [
            ("c0", f"""SELECT attempt_no, segs, count(*) AS attempts, {_rsum('is_contact')} AS contacts,
  {_rsum('is_sale')} AS sales FROM attempts WHERE {first_k} GROUP BY attempt_no, segs"""),
            ("c", f"""SELECT *, {_r(_ratio('contacts', 'attempts') + scale)} AS contact_perc,
  {_r(_ratio('sales', 'contacts') + scale)} AS sales_perc FROM c0"""),
        ]

    q["attempt_rates_long"] = _q(rates(""), _long(
        "c", ["attempt_no", "segs", "attempts", "contacts", "sales"], ["contact_perc", "sales_perc"],
        "key", "value"), p)
    q["attempt_counts_long"] = _q(rates(" * 100"), _long(
        "c", ["attempt_no", "segs", "attempts", "contact_perc", "sales_perc"], ["contacts", "sales"],
        "key", "value"), p)

    def result_dist(contact: int, min_perc) -> str:
        keep = f"WHERE perc > {min_perc}" if min_perc is not None else ""
        return _q([
            ("r", f"""SELECT segs, result_cat, count(*) AS rows FROM attempts
WHERE {TWEAK} AND is_contact = {contact} GROUP BY segs, result_cat"""),
            ("s", f"""SELECT * FROM (
  SELECT *, {_r(_ratio('rows', 'sum(rows) OVER (PARTITION BY segs)'))} AS perc FROM r) x {keep}"""),
            ("m", f"""SELECT *, sum({_h('perc')}) OVER (PARTITION BY result_cat)
  / count(*) OVER (PARTITION BY result_cat) AS mean_key FROM s"""),
        ], """SELECT segs, result_cat, rows, perc,
  CASE WHEN result_cat IS NOT NULL THEN CAST(dense_rank() OVER (
      PARTITION BY result_cat IS NULL ORDER BY mean_key, result_cat) AS INTEGER)
    ELSE (SELECT CAST(count(DISTINCT result_cat) + 1 AS INTEGER) FROM m) END AS cat_order FROM m""", p)

    q["result_dist_noncontact"] = result_dist(0, None)
    q["result_dist_contact"] = result_dist(1, p.contact_share_min)
    q["finish_codes"] = _q([], "SELECT result2, count(*) AS rows FROM attempts GROUP BY result2", p)

    ordinals = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth",
                "ninth", "tenth"]
    n = p.sequence_cap - 1
    names = [ordinals[i] if i < len(ordinals) else f"attempt_{i + 1}" for i in range(n)]
    cells = ",\n  ".join(f"max(CASE WHEN attempt_no = {i + 1} THEN result_cat END) AS {nm}"
                         for i, nm in enumerate(names))
    paste = ", ".join(f"coalesce({nm}, 'NA')" for nm in names)
    q["attempt_sequences"] = _q([
        ("w", f"""SELECT segs, id,
  {cells}
FROM attempts WHERE attempt_no < {p.sequence_cap} AND segs = '{p.sequence_segment}' GROUP BY segs, id"""),
        ("f", f"""SELECT segs, concat_ws(', ', {paste}) AS sequence, count(*) AS freq
FROM w GROUP BY segs, concat_ws(', ', {paste})"""),
        ("s", f"SELECT *, {_r(_ratio('freq', 'sum(freq) OVER (PARTITION BY segs)'))} AS freq_perc FROM f"),
    ], f"SELECT * FROM s WHERE freq_perc >= {p.sequence_share_min}", p)

    def att(flag: str, name: str) -> str:
        return _q([("a", f"SELECT customer_att, {flag}, count(*) AS rows FROM attempts GROUP BY customer_att, {flag}")],
                  f"""SELECT customer_att, {flag}, rows,
  {_r(_ratio('rows', 'sum(rows) OVER (PARTITION BY customer_att)'), 3)} AS {name} FROM a""", p)

    q["att_contact"] = att("is_contact", "contact_perc")
    q["att_sale"] = att("is_sale", "sale_perc")

    def talk(key: str) -> list[tuple[str, str]]:
        return [
            ("tw", f"SELECT *, CAST({key} AS VARCHAR) AS k_txt FROM attempts WHERE {TWEAK}"),
            ("t0", f"""SELECT segs, k_txt AS {key}, {_r(_ratio(_rsum('length'), '3600'))} AS hours,
  {_rsum('is_sale')} AS sales FROM tw GROUP BY segs, k_txt"""),
            ("t", f"SELECT segs, {key}, hours, sales, {_r(_ratio('sales', 'hours'))} AS sales_hour FROM t0"),
        ]

    week, hour = talk("placed_week"), talk("placed_hour")
    q["sales_per_week"] = _q(week, "SELECT * FROM t", p)
    q["sales_hour_by_week"] = _q(week, _wide("t", ["segs"], "placed_week", "sales_hour", week_txt, True), p)
    q["sales_by_week"] = _q(week, _wide("t", ["segs"], "placed_week", "sales", week_txt, True), p)
    q["hours_by_week"] = _q(week, _wide("t", ["segs"], "placed_week", "hours", week_txt, True), p)
    q["sales_hours_long"] = _q(week, _long("t", ["segs", "placed_week"], ["hours", "sales"], "key", "value"), p)
    q["sales_hour_line"] = _q(week, "SELECT segs, placed_week, sales_hour FROM t", p)
    q["sales_per_hour"] = _q(hour, "SELECT * FROM t", p)
    q["sales_hour_by_hour"] = _q(hour, _wide("t", ["segs"], "placed_hour", "sales_hour", hour_txt, True), p)
    q["sales_by_hour"] = _q(hour, _wide("t", ["segs"], "placed_hour", "sales", hour_txt, True), p)
    q["hours_by_hour"] = _q(hour, _wide("t", ["segs"], "placed_hour", "hours", hour_txt, True), p)
    q["sales_hour_by_hour_line"] = _q(
        hour, f"SELECT segs, placed_hour, sales_hour FROM t WHERE placed_hour NOT IN ({left_out})", p)

    def birth(where: str) -> str:
        return _q([("b", f"""SELECT segs,
  CASE WHEN date_of_birth IS NULL THEN 0 WHEN date_of_birth = '--' THEN 1 ELSE 0 END AS no_birth,
  count(*) AS rows FROM attempts WHERE {where} GROUP BY 1, 2""")],
                  f"""SELECT segs, no_birth, rows,
  {_r(_ratio('rows', 'sum(rows) OVER (PARTITION BY segs)'))} AS no_birth_perc FROM b""", p)

    q["birth_missing"] = birth("TRUE")
    q["birth_missing_cases"] = birth("attempt_no = 1")
    q["uncategorised"] = _q([], "SELECT * FROM attempts WHERE result_cat IS NULL", p)

    tt = [
        ("tw", f"""SELECT *, CAST(placed_week AS VARCHAR) AS week_txt FROM attempts
WHERE {TWEAK} AND CAST(placed_week AS VARCHAR) < '{p.week_cap_text}'"""),
        ("t0", f"""SELECT segs, result_cat, week_txt AS placed_week,
  {_r(_ratio(_rsum('length'), '3600'))} AS length_h, {_rsum('is_sale')} AS sales
FROM tw GROUP BY segs, result_cat, week_txt"""),
        ("t", f"""SELECT segs, result_cat, placed_week, length_h AS length, sales,
  {_r(_ratio('sales', 'length_h'))} AS sales_hour FROM t0"""),
    ]
    q["talk_time_by_result"] = _q(tt, "SELECT * FROM t", p)
    q["talk_time_by_result_wide"] = _q(
        tt, _wide("t", ["segs", "result_cat", "sales", "sales_hour"], "placed_week", "length", week_txt, True), p)
    q["talk_time_share_wide"] = _q(tt + [
        ("sp", f"""SELECT segs, result_cat, placed_week, sales, sales_hour,
  {_r(_ratio(_h('length'), _rsum_over(_h('length'), '(PARTITION BY segs, placed_week)')) + ' * 100')} AS length_perc
FROM t"""),
    ], _wide("sp", ["segs", "result_cat", "sales", "sales_hour"], "placed_week", "length_perc", week_txt, True), p)
    q["talk_time_share"] = _q(tt + [
        ("s1", f"""SELECT segs, result_cat, placed_week, sales,
  {_r(_ratio(_h('length'), _rsum_over(_h('length'), '(PARTITION BY segs, placed_week)')))} AS length_perc
FROM t WHERE result_cat IS NOT NULL"""),
    ], f"""SELECT segs, result_cat, placed_week, sales, length_perc,
  {_ratio(_h('length_perc'), _rsum_over(_h('length_perc'), '(PARTITION BY segs, placed_week)'))} AS bar_share
FROM s1""", p)

    q["month_compare"] = _q([], f"""SELECT placed_month, {_ndist('customer')} AS records, count(*) AS attempts,
  {_rsum('is_contact')} AS effectieven, {_rsum('is_sale')} AS positieven
FROM attempts WHERE placed_month IN ({months}) GROUP BY placed_month""", p)

    # texts that do not parse
    def lost(name: str, raw: str, parsed: str) -> str:
        return (f"SELECT '{name}' AS variable_name, count({raw}) AS texts, "
                f"count(*) FILTER ({raw} IS NOT NULL AND {parsed} IS NULL) AS lost FROM raw")

    def dated(raw: str, *formats: str) -> str:
        return "coalesce(" + ", ".join(f"try_strptime({raw}, '{f}')" for f in formats) + ")"

    q["parse_losses"] = _q([], "\nUNION ALL\n".join([
        lost("sub_start_date", "SUB_START_DATE", dated("SUB_START_DATE", "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d")),
        lost("placed_time", "CALLPLACEDTIME", dated("CALLPLACEDTIME", "%Y-%m-%d %H:%M:%S")),
        lost("answered_time", "CALLANSWEREDTIME", dated("CALLANSWEREDTIME", "%Y-%m-%d %H:%M:%S")),
        lost("is_contact", "ISCONTACT", "TRY_CAST(trunc(TRY_CAST(ISCONTACT AS DOUBLE)) AS INTEGER)"),
        lost("is_sale", "IS_SALE", "TRY_CAST(trunc(TRY_CAST(IS_SALE AS DOUBLE)) AS INTEGER)"),
        lost("date_of_birth", "DATE_OF_BIRTH", dated("DATE_OF_BIRTH", "%d-%m-%Y", "%d/%m/%Y", "%d%m%Y")),
    ]), p)

    # the dictionary of the raw extract
    cols = list(DESCRIPTIONS)
    stats = "\nUNION ALL\n".join(f"""SELECT '{c}' AS variable_name, '{DESCRIPTIONS[c]}' AS description,
  {int(c in VALUE_COLUMNS)} AS variable_type, count(*) - count({c}) AS n_missing,
  {f'(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))' if c in VALUE_COLUMNS else 'NULL'} AS n_distinct,
  {'NULL' if c in VALUE_COLUMNS else f'CAST(min({c}) AS VARCHAR)'} AS "min",
  {'NULL' if c in VALUE_COLUMNS else f'CAST(max({c}) AS VARCHAR)'} AS "max" FROM raw""" for c in cols)
    q["data_dictionary"] = _q([], stats, p)
    q["dictionary_values"] = _q([], "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variable_name, CAST({c} AS VARCHAR) AS value, count(*) AS rows FROM raw GROUP BY {c}"
        for c in VALUE_COLUMNS), p)
    return q
