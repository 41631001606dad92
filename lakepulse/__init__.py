"""Product-event analytics on a partitioned data lake, written for PySpark."""
