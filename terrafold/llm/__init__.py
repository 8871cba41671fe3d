"""Operators for preparing training text: filters, de-duplication, mixing, packing and search."""
