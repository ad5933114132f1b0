-- Raw dial-attempt extract built from the test tables (FIXTURES.md section 3), Spark SQL.
-- Run with: python -m dialmetrics.plans.runner --views <sf dir> --sql examples/fixture_extract.sql ...
-- Add "WHERE c.c_acctbal >= 0" to cust and drop LENGTH for the older extract.
WITH first_order AS (
  SELECT o_custkey, min(o_orderdate) AS first_order_date
  FROM orders
  GROUP BY o_custkey
),
cust AS (
  SELECT c.c_custkey, c.c_mktsegment, n.n_name, f.first_order_date
  FROM customer c
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN first_order f ON f.o_custkey = c.c_custkey
),
moved AS (
  SELECT *, CASE
    WHEN user_id % 13 = 1 THEN ts + INTERVAL 31 DAYS
    WHEN user_id % 10 = 0 THEN CAST(date_sub(CAST(ts AS DATE), weekday(ts)) AS TIMESTAMP_NTZ)
    ELSE ts END AS at
  FROM events
)
SELECT
  e.user_id * 4 + e.event_id % 4 AS CASE_ID_T,
  e.user_id AS KLANTNR,
  CASE c.c_mktsegment
    WHEN 'HOUSEHOLD' THEN 'A' WHEN 'MACHINERY' THEN 'C' WHEN 'FURNITURE' THEN 'E'
    WHEN 'AUTOMOBILE' THEN 'I' WHEN 'BUILDING' THEN 'Z' END AS SEGMENT,
  concat('B', CAST(e.user_id % 3 AS STRING)) AS BATCH_TYPE,
  concat('ATT', CAST(e.user_id % 4 AS STRING)) AS CUSTOMER_ATT,
  c.n_name AS CURRENT_SUB,
  CAST(CAST(c.first_order_date AS DATE) AS STRING) AS SUB_START_DATE,
  CASE WHEN e.user_id % 7 = 0 THEN '--' ELSE '01-02-1980' END AS DATE_OF_BIRTH,
  CASE WHEN e.event_id % 97 <> 5 THEN substring(CAST(e.at AS STRING), 1, 19) END AS CALLPLACEDTIME,
  CASE WHEN e.event_type IN ('click', 'purchase')
    THEN substring(CAST(e.at + INTERVAL 20 SECONDS AS STRING), 1, 19) END AS CALLANSWEREDTIME,
  CASE
    WHEN c.c_mktsegment = 'HOUSEHOLD' AND floor((dayofyear(e.at) - 1) / 7) + 1 = 3
      AND e.event_type NOT IN ('purchase', 'click') AND e.event_id % 33 IN (10, 11) THEN NULL
    WHEN c.c_mktsegment = 'FURNITURE' AND floor((dayofyear(e.at) - 1) / 7) + 1 = 4 THEN 0
    ELSE CAST(floor(e.value) AS BIGINT) END AS LENGTH,
  CASE WHEN e.event_type IN ('click', 'purchase') THEN '1' ELSE '0' END AS ISCONTACT,
  CASE WHEN e.event_type = 'purchase' THEN '1' ELSE '0' END AS IS_SALE,
  CASE
    WHEN e.event_type = 'purchase' THEN 'Afgehandeld'
    WHEN e.event_type = 'click' THEN
      CASE WHEN e.event_id % 2 = 0 THEN 'Afgehandeld' ELSE 'Terugbellen' END
    ELSE element_at(array(
      'NoAnswer', 'Voicemail', 'Afgehandeld', 'Terugbellen', 'No Circuit', 'System Hang Up',
      'GeenGehoor', 'Bel Later Terug', 'Unassigned Number (ISDN Cause Code 01)',
      'No User Responding (ISDN Cause Code 18)', 'Busy', 'InGesprek', 'Bad Number',
      'No Route To Destination (ISDN Cause Code 03)', 'Reorder',
      'Call Rejected (ISDN Cause Code 21)', 'NotReached', 'Policy Scheduled',
      'Invalid Number Format (ISDN Cause Code 28)', 'Normal, Specified (ISDN Cause Code 31)',
      'Ineffective Other', 'Remote Hang Up', 'NoLines', 'Agent not available for callback',
      'Recovery On Timer Expiry (ISDN Cause Code 102)', 'Vacant Code',
      'User Alerting No Answer (ISDN Cause Code 19)', 'Number Changed (ISDN Cause Code 22)',
      'Failed to route call to agent.', 'Incoming Calls Barred Within CUG (ISDN Cause Code 55)',
      'Agent Logout', 'Onbekend', CAST(NULL AS STRING)
    ), CAST(e.event_id % 33 + 1 AS INT))
  END AS FINISHCODE,
  e.event_id
FROM moved e
JOIN cust c ON c.c_custkey = e.user_id
