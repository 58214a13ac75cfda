"""Sources of articles and events as DataFrames."""
