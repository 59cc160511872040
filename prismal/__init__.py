"""prismal: representational-similarity analytics expressed as Spark DataFrame jobs."""
