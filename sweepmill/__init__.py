"""Spark-native analytics for recorded range, inertial and camera captures."""
