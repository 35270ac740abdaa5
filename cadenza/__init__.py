"""Frame-oriented sequence analytics and corpus preparation on Spark."""
