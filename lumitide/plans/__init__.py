"""Documents that describe an edit, and their compilation to one lazy lineage of DataFrames."""
