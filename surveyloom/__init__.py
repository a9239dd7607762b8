"""Analytics for categorical and ordinal survey tables, on Spark DataFrames."""
