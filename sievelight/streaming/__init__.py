"""Sievelight streaming."""
