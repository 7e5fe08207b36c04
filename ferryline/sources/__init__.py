"""Bounded reads: topic ranges and file ranges."""
