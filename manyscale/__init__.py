"""Multi-scale geometric analysis of vector tables on Spark DataFrames."""
