"""The same operators over streams of documents, conversations and events."""
