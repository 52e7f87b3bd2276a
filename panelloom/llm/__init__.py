"""Operators for preparing training text, each ``DataFrame -> DataFrame``; nothing else in the library imports them."""
