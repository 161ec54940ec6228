"""Relational operators: predicates, matching, blocks, summaries, drift."""
