"""Scalar functions: text rules, wikitext, token diffs."""
