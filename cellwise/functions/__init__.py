"""Column functions: grid, periods, projections, statistics."""
