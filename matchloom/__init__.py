"""matchloom: evidence-grounded profile matching analytics on Spark DataFrames."""
