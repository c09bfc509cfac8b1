"""Operators of a training-data pipeline. Nothing else in ``tally`` imports this package."""
