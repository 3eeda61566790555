"""Operators over frames."""
