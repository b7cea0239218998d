"""guardframe: prompt-security analytics over Spark DataFrames."""
