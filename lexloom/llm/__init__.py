"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
