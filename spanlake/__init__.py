"""Sensitive-text analytics on Spark: detection, review, pseudonyms, scoring."""
