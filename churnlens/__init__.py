"""Spark jobs for software-change and code-risk data, and for training-data corpora."""
