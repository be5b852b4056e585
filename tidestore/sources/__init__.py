"""Readers and writers of stored samples, catalogs and round-robin archives."""
