"""Gridded Earth-observation and territorial analytics as Spark DataFrame plans."""
