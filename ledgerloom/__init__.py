"""Ledger analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns). Money is DECIMAL(18,2) until the last projection. There is no Python
UDF anywhere: all row work is built-in Catalyst expressions.
"""
