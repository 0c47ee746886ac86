"""Scalar text and codec functions as column expressions."""
