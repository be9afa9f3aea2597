"""Operators for building training data: one module for each, each with its own queries."""
