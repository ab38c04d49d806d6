"""Sievelight plans."""
