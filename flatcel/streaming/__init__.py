"""Micro-batch entry points for the incremental operators."""
