"""Scalar functions and registered functions."""
