"""Operators that a training-data pipeline needs. Nothing outside this folder imports it."""
