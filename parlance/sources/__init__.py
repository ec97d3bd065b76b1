"""Readers and writers: chat exports, dictionaries, intermediates, reports."""
