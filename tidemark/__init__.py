"""Space-time feature analytics and corpus preparation on PySpark."""
