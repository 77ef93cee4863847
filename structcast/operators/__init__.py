"""Extraction of typed values from text columns, their checks and rollups."""
