"""Whole plans: configuration, audit, reports and the query catalogue."""
