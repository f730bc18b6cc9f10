"""Queries, joins, statistics, indexes and updates over box tables."""
