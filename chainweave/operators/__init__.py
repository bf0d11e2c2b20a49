"""Relational operators: mentions, pairs, features, scores, decoding, clusters, metrics, analyses."""
