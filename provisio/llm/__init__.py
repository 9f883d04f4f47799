"""Operators for preparing training and retrieval text; nothing outside this folder imports it."""
