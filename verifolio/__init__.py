"""verifolio: document extraction checks, repairs and publishing plans on Spark DataFrames."""
