"""Operators of the barrier-touch analysis."""
