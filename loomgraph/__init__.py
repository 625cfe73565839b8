"""Knowledge graphs from tables, and their analysis, as Spark DataFrames."""
