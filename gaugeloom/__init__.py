"""Spark-native analytics for operational telemetry."""
