"""Activity, recall and corpus analytics as Spark DataFrame jobs."""
