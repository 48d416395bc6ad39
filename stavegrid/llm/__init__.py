"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage.  Each operator lives in
its own module; :mod:`stavegrid.llm.queries` holds the thin registered queries.
"""
