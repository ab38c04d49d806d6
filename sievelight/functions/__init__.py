"""Sievelight functions."""
