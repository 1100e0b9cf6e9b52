"""The SQL front end: temporal clauses become plans, the rest is Spark SQL."""
