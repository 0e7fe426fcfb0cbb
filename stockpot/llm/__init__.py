"""Operators for preparing training data: scanning, mixing, packing, scoring and de-duplication.

Nothing outside this subpackage imports it.
"""
