"""Spark-native analytics for hourly electricity data and workload start-hour decisions."""
