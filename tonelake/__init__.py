"""Spark-native analytics over filings, calls, guidance and prices."""
