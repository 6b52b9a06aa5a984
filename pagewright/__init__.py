"""Page layout, table reconstruction and text search over Spark DataFrames."""
