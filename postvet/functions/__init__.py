"""Column expressions and DataFrame helpers shared by the jobs."""
