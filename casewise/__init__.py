"""casewise: reusable tabular-analytics operators for PySpark DataFrames."""
