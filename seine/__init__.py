"""Secret scanning and file comparison as Spark DataFrame operators."""
