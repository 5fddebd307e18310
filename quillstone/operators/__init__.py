"""Relational operators: field extraction, postings, shards, query parsing, ranked search."""
