"""Event analytics, anomaly scoring and alerting as Spark DataFrame jobs."""
