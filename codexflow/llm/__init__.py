"""Operators that prepare training text for language models.

Nothing else in the package imports this subpackage.
"""
