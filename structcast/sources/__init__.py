"""Readers and writers around an extraction."""
