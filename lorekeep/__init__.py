"""lorekeep: narrative evidence retrieval and corpus preparation on PySpark."""
