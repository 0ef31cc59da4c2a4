"""canvasser: outreach analytics on Spark DataFrames."""
