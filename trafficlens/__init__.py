"""trafficlens: web and application log analytics as plain Spark DataFrames."""
