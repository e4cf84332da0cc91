"""Vectors: element-wise operators, subscripts, subset, assignment, apply."""
