"""Evidence and impact analysis on Spark DataFrames."""
