"""Spark-native analytics for detection datasets: grouping, splitting, matching and scoring."""
