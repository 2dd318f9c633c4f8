"""Relational operators on product facts."""
