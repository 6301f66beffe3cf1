"""Operators for building training data from web-scale text. Nothing outside this folder imports it."""
