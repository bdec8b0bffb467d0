"""Operators for building training corpora: packing, search, scoring, filtering, de-duplication, tokenizing.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
