"""Corpus-preparation operators for training text; nothing outside this subpackage imports it."""
