"""Payload decoding, ranking, scanning and encoding as Spark columns, tables and functions."""
