"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries; every other module is one operator with its own
general interface.
"""
