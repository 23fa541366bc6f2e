"""A relation-graph engine on Spark DataFrames."""
