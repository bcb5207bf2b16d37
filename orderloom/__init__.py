"""Purchase-order analytics expressed as PySpark DataFrame jobs."""
