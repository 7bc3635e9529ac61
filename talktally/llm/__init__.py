"""Operators for preparing training text, and their registered queries."""
