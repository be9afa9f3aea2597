"""Space-use analytics and corpus preparation as Spark jobs."""
