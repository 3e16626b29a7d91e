"""Narrative-consistency analytics and corpus building as PySpark jobs."""
