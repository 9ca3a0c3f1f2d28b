"""Readers and writers for sequence, label, structure and feature data."""
