"""Knowledge-base analytics expressed as Spark DataFrame jobs."""
