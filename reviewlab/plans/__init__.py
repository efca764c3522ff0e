"""Whole experiments, the catalogue of checkable queries and their SQL counterparts."""
