"""Market-bar analytics as Spark jobs over multi-instrument tables."""
