"""Knowledge-graph analytics on PySpark DataFrames."""
