"""Structured Streaming forms of import and burst detection."""
