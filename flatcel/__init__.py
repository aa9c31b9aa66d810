"""Spark DataFrame operators for very large collections of animation frames."""
