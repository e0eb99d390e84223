"""Spark jobs for alternative splicing at scale; see README.md."""
