"""Operators of a training-data pipeline: archives, tokens, near-duplicates, mixing, search, sharding, language.

Nothing outside this package imports it.  Every operator takes DataFrames and returns DataFrames;
the thin queries in :mod:`creditflow.llm.queries` apply them to whole tables.
"""
