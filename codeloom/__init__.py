"""codeloom: property-graph analytics over source code and related artifacts, on Spark DataFrames."""
