"""Corpus operators for training data. Nothing outside this subpackage imports it."""
