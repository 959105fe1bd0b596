"""Data contracts, reference resolution and corpus jobs as plain Spark DataFrames."""
