"""lifeloom: statement-lifecycle analytics on Spark DataFrames."""
