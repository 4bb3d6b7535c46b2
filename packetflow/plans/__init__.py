"""Query catalogue: each query as a Spark plan, with its SQL for checking."""
