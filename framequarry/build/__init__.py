"""Packet builders."""
