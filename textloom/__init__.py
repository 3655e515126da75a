"""Text forensics and corpus curation on Spark DataFrames."""
