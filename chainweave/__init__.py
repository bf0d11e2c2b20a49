"""Document-level coreference analytics and text pipelines on Spark DataFrames."""
