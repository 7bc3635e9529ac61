"""Conversation metrics on Spark: normalise results, count, derive, index and serve."""
