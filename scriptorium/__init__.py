"""Document-record analytics and training-data preparation on PySpark."""
