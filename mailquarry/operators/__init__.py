"""Relational operators: retrieval, deduplication, assembly, validation, scoring, reports and statistics."""
