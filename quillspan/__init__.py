"""Web-text analytics on Spark: HTML conversion, extraction, chunking and corpus operators."""
