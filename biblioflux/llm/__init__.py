"""Operators on text and records for training corpora; nothing else in the library imports this subpackage."""
