"""Operators over tables: keyed updates, the mapping store, restoring, integrity checks, foreign keys."""
