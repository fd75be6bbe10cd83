"""Readers, writers and lineage cuts."""
