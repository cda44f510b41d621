"""Whole studies assembled from the operators."""
