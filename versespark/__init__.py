"""Batch jobs on Spark that find and score re-use of a verse-numbered text in large corpora."""
