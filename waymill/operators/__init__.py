"""Operators over the street network, its routes and their training data."""
