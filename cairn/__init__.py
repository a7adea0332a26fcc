"""cairn: archive analytics as Spark DataFrame programs."""
