"""dialmetrics: outbound-calling campaign analytics as Spark DataFrame jobs.

Layers:
  sources    -- raw dial-attempt extract (SQL text, JDBC, parquet, test tables), sinks
  functions  -- column expressions with R-compatible missing-value, division and rounding rules
  operators  -- derivation of the attempts table, attempt numbering, metric blocks,
                shares, long/wide reshapes
  plans      -- the named reports (one function each), parameters, query registry
  streaming  -- the row-wise derivation applied to a file stream of extracts
"""

__version__ = "0.1.0"
