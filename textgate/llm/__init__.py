"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; :mod:`textgate.llm.queries` registers the thin ``opN_`` queries.
"""
