"""twinloom - produce and audit synthetic tables with Spark DataFrames."""
