"""Retail sales reconciliation engine expressed in Spark DataFrames."""
