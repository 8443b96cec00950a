"""Attack-graph analytics as Spark jobs."""
