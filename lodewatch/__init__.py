"""Security analytics over text, telemetry and build records as Spark DataFrames."""
