"""Geospatial vector analytics on building-footprint tables, as Spark DataFrame jobs."""
