"""Registered queries of the chunking operators, with their SQL."""
