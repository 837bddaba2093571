"""Readers and writers: ledger, statements, bank feed, insights, and views over the star-schema tables."""
