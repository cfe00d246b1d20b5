"""Operators for preparing training data: one module per operator.

Nothing outside this folder imports from it.
"""
