"""Spark-native analytics for capacity-limited triage of irregular time-series alerts."""
