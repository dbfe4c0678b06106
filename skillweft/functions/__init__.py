"""Column expressions; Python only where Spark has no expression for the job."""
