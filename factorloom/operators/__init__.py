"""Operators on ratings, factors and predictions, as DataFrame plans."""
