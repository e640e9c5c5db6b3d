"""Operators that prepare language-model training data at scale; nothing else in the library imports this subpackage."""
