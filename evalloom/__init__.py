"""Spark jobs for paired evaluations of reviewers, and for preparing training data at scale."""
