"""Identity resolution, relationship analytics and corpus preparation with Spark DataFrames."""
