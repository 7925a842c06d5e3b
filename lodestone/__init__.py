"""Knowledge-graph analytics over source code and documents, as Spark DataFrame jobs."""
