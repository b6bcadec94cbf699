"""Spark-native analytics for places, routes and trips."""
