"""quern: corpus preparation and retrieval evaluation as Spark DataFrame jobs."""
