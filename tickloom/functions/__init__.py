"""Scalar functions: names and codes, numbers, text and subscription messages."""
