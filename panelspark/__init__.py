"""panelspark: solar-array soiling and detection-quality analytics on Spark DataFrames."""
