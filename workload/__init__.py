"""Queries over the benchmark tables and their reference SQL."""
