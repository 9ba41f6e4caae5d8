"""Retrieval-trust analytics as set-oriented Spark programs."""
