"""Operators for training-data pipelines: deduplication, decontamination, tokens, chat, search, toxicity.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""
