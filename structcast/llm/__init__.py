"""Operators of a training-data pipeline: search, deduplication, decontamination, tokens, quality, language models."""
