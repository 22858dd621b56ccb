"""Operators on sparse spatial counts, molecules and fields, as DataFrame functions."""
