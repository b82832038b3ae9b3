"""Operators for preparing training data, each over a whole DataFrame.

Nothing else in the library imports this subpackage.
"""
