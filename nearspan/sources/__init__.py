"""Readers of corpora, dictionaries, matrices and whole files."""
