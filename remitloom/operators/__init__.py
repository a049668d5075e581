"""Reusable, parameterised DataFrame operators."""
