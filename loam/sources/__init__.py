"""Readers and writers of documents and chunks."""
