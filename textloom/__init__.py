"""textloom: document and corpus analytics on Spark DataFrames."""
