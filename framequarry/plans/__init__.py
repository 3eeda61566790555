"""Filters, and the registered queries."""
