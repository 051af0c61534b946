"""Scalar Column expressions."""
from . import cleaning, features  # noqa: F401
