"""Readers of landed provider payloads and stored tables."""
