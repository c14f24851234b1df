"""millrace: map/reduce data flow and analyses on PySpark DataFrames."""
