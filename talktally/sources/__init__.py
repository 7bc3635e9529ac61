"""Readers and writers for the bronze, silver and gold tables."""
