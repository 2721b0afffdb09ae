"""Point-in-time factor research as Spark DataFrame jobs."""
