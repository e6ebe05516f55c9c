"""vigipanel: PySpark operators for public-health surveillance panels."""
