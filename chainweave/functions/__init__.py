"""Scalar functions as native columns."""
