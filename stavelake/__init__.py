"""Spark operators over corpora of recognised scores."""
