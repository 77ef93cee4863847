"""Texts that arrive in chunks: replay of finished streams, and live streams."""
