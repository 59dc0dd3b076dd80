"""Analytics over streams of text documents, on DataFrames, Spark SQL and Structured Streaming."""
