"""Operators for preparing text and records for training. Nothing outside this subpackage imports it."""
