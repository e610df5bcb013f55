"""Motif analytics for functional data on Spark."""
