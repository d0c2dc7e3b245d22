"""Readers and writers of record logs."""
