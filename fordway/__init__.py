"""Spark-first analytics over road networks, hazard areas and reachable services."""
