"""spanloom: span analytics on PySpark."""
