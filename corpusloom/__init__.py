"""Spark jobs for structural code intelligence and text-corpus analysis."""
