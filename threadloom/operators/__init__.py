"""Operators over DataFrames of messages, campaigns, metrics and documents."""
