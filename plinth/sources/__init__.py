"""Readers, writers and validators of files."""
