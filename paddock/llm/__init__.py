"""Operators that prepare training text: deduplication, packing, filtering, formatting and detection."""
