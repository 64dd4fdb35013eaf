"""Spark-native search for drifting narrowband signals."""
