"""trackweave: group-movement analytics on GPS tracks, as PySpark DataFrames."""
