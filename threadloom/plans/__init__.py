"""Composite reports, and the queries over the driver's tables."""
