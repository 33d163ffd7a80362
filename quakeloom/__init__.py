"""quakeloom: earthquake-catalog analytics as Spark DataFrame plans."""
