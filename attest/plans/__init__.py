"""Checks and flows composed from the operators."""
