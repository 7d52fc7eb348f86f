"""Composed plans: rendering, multi-show reports, the query catalogue."""
