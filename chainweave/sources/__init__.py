"""Readers and writers of annotated text, dictionaries, features and clusterings."""
