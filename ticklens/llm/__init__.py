"""Operators for training-data pipelines; see ``queries`` for what is registered.

Nothing else in the package imports this subpackage.
"""
