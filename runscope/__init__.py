"""Spark-native analytics for the event logs of long-running autonomous agent sessions."""
