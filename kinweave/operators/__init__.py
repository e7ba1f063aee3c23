"""Relational and iterative operators of record linkage."""
