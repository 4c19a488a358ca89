"""Operators that prepare text and code for training language models.  Nothing outside this subpackage imports it."""
