"""Alert enrichment and triage on Spark DataFrames."""
