"""Operators for building training data from very large corpora, and their queries."""
