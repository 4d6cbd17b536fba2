"""Specification of models, and the registered queries."""
