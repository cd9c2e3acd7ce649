"""Evidence reconciliation on Spark DataFrames."""
