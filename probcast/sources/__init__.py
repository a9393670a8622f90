"""Readers, writers and the mapping from generic tables to the domain tables."""
