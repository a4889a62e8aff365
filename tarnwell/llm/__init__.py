"""Corpus preparation operators: ten operators, their queries and their SQL."""
