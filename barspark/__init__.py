"""barspark: bar-series features, alignment, drift, decisions and parity checks as Spark jobs."""
