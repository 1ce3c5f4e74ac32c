"""Operators that turn raw document tables into training data; nothing else in the library imports them."""
