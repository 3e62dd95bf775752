"""Operators for corpora that train language models. Nothing else in the library imports them."""
