"""attestra: evidence-based entity resolution as Spark DataFrame programs."""
