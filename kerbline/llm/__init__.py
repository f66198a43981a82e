"""Operators of a large-scale training-data pipeline, each as Spark jobs.

Nothing else in the library imports this subpackage.
"""
