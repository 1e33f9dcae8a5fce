"""riskspark: credit-risk analytics as Spark DataFrame jobs."""
