"""Readers, writers and views that give records."""
