"""Run-history analytics, data quality gates and medallion steps as Spark DataFrames."""
