"""A privacy-aware analytics engine expressed in PySpark DataFrames."""
