"""Whole plans: the funnel, the registered queries, and their SQL counterparts."""
