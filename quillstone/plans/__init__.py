"""Whole jobs: building an index and searching a stored one."""
