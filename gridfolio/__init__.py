"""Panel analytics on PySpark: date x ticker tables as long DataFrames."""
