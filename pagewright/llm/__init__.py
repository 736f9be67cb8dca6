"""Operators that prepare web text for training language models. Nothing outside this package imports it."""
