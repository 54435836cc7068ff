"""papertide: bibliographic trend analytics as Spark jobs."""
