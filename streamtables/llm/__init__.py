"""Operators for preparing training text: deduplication, scoring, fingerprints, mixing, packing, chat."""
