"""Operators for preparing training text: filters, joins, codecs, archives.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
