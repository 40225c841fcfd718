"""A ledger reconciliation engine on Spark DataFrames."""
