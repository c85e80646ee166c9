"""vellum: scan-document analytics on Spark DataFrames."""
