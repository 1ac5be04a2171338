"""Operators from DataFrame to DataFrame: spatial joins, graphs, routing, accessibility, exposure, tables."""
