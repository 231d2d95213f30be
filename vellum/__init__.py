"""A versioned record catalogue as Spark DataFrame jobs."""
