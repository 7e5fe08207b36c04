"""Bounded streaming runs."""
