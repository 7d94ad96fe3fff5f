"""Knowledge-graph privacy analytics on Spark."""
