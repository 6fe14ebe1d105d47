"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it; the entry module adds its queries
only when it can be imported.
"""
