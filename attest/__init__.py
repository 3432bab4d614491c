"""Provenance, policy and status analytics as plain DataFrame operators."""
