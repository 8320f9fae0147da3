"""Hardware-design analytics on PySpark."""
