"""Readers, writers and adapters to outside parsers and services."""
