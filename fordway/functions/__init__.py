"""Column functions: geometry, measures, scores."""
