"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
``opN_*`` queries, ``oracles`` their SQL where SQL can express them.
"""
