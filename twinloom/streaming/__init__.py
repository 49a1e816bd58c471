"""Structured Streaming forms of the ledger queries."""
