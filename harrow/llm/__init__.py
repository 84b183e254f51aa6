"""Operators for preparing language-model training data.

Each module holds one operator with its own interface; ``registered`` derives
the driver queries from them.  Nothing outside this subpackage imports it.
"""
