"""ledgerloom: cleaning, loading and analysing dirty order data on Spark DataFrames."""
