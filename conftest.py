"""Puts the repository's top folder on the path of the tests."""
