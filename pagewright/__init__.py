"""pagewright: document analytics on PySpark DataFrames."""
