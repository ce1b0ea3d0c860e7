"""Operators for preparing training text: tokens, duplicates, filters, packing, media."""
