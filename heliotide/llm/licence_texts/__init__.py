"""Whole licence texts, one file each, named by their identifier."""
