"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

Every operator reads only the id and text columns it is told about, so extra input
columns, whatever their names, neither clash nor matter; results carry the id and the
operator's own columns.
"""
