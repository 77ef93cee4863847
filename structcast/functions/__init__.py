"""Scalar rules: numbers and text as JSON's home language sees them, and readings of noisy text."""
