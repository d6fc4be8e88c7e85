"""Operators for building training data from text; nothing outside this subpackage imports it."""
