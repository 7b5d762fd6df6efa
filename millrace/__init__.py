"""millrace: a PySpark-native analytics library built on DataFrames, SQL and Structured Streaming."""
