"""Operators of a training-data pipeline: filtering, deduplication, tokenising, scoring, archives."""
