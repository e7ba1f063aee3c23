"""Readers, writers and the scratch tables that cut lineage."""
