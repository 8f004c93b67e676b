"""granary: software-inventory analytics on PySpark DataFrames."""
