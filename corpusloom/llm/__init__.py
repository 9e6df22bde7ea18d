"""Operators for preparing training data at scale.

Nothing outside this folder (and the pipeline file at the repository top)
imports it, so it can be removed as a unit.
"""
