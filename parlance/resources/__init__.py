"""Vocabularies, phrase lists, emoji ranges."""
