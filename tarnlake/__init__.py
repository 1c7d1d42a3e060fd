"""tarnlake: a log lake and text-search engine expressed in PySpark DataFrames."""
