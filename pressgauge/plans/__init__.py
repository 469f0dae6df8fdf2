"""Whole jobs: the staged pipeline, the registered queries, and their SQL counterparts."""
