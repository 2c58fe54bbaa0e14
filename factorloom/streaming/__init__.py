"""Operators for streams of predictions."""
