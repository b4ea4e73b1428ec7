"""Operators of a large-scale training-data pipeline, one module per operator.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin
registered queries; the operators keep their own general interfaces.
"""
