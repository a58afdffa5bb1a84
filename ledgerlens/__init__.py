"""Payment-fraud and personal-finance analytics on Spark DataFrames and streams."""
