"""Patient-data de-identification and clinical analytics on Spark DataFrames."""
