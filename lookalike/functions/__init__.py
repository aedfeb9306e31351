"""Column expressions: projections, scores, classes, names, and similarity signatures."""
