"""Conversion profiles and whole-batch plans."""
