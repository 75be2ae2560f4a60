"""Readers, writers and the canonical tables that queries start from."""
