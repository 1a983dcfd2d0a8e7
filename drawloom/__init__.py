"""Document-tag extraction, list reconciliation and revision diffs on Spark DataFrames."""
