"""Operators for building training-data corpora; nothing else in the library imports this subpackage."""
