"""quarrymill: Spark-native analytics for web pages, company profiles and pipeline telemetry."""
