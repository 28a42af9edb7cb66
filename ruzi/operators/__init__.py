"""Relational operators over bound plans, as DataFrame transformations."""
