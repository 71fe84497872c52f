"""Document-intelligence engine on Spark DataFrames."""
