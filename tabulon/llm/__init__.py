"""Operators for corpora of texts. Nothing outside this subpackage imports it."""
