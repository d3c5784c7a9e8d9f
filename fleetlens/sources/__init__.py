"""Readers of raw dumps and writers of enriched samples."""
