"""Readers and writers of box files and dumps."""
