"""Operators, DataFrame -> DataFrame. Each works for all keys at once."""
