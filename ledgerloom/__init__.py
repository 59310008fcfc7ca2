"""Ledgerloom: record linkage and entity reconciliation on Spark DataFrames."""
