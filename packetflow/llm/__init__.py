"""Operators for training data built on packets; nothing outside this subpackage imports it."""
