"""Tessera: a SQL engine with versioned tables on Spark DataFrames."""
