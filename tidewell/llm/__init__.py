"""Operators on free text and typed names for training-data pipelines.

Nothing outside this subpackage imports it.
"""
