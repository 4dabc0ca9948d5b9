"""Readers: event tables, raw records, offsets, and the fixture generator."""
