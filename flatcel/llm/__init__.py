"""Operators of a training-data pipeline: dedup, scans, filters, scores, mixing."""
