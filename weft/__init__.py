"""Property-graph search and rewriting on DataFrames."""
