"""lexigauge: recognition-quality analytics on PySpark DataFrames."""
