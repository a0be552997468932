"""Table-level Spark jobs over stored static-analysis reports."""
