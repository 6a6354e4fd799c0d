"""Operators for preparing training text: mixing, filtering, deduplication, formatting and attribution.

Nothing outside this subpackage imports it.  ``queries.py`` registers one thin query per operator.
"""
