"""Distributed operators and fits."""
