"""Readers of files and configurations."""
