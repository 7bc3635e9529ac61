"""Checks of the registered queries: derived inputs, queries and their SQL."""
