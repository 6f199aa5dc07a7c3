"""Application-security findings analytics as Spark jobs."""
