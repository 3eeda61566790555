"""Packet-capture analytics as Spark DataFrames."""
