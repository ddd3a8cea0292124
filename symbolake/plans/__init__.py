"""Whole plans: build a snapshot from a tree, refresh it, store and load it."""
