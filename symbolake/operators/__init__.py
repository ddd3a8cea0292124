"""Operators over symbol tables, DataFrame in and DataFrame out."""
