"""Spark jobs that turn document collections into reviewed, linked facts."""
