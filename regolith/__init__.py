"""Terrain hazard, traverse planning and mission jobs as Spark DataFrame pipelines."""
