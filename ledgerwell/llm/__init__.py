"""Operators of a training-data pipeline: counting, cleaning, near duplicates, packing."""
