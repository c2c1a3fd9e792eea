"""scriptloom: bulk Chinese text standardisation on Spark DataFrames."""
