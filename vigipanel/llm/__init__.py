"""Operators for preparing training text: deduplication, decontamination, filters, scans and mixing."""
