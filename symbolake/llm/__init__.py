"""Operators of a training-data pipeline: ten stages from sharding to chat formatting.

Nothing outside this package imports it. ``queries`` holds the registered
queries and their SQL; every other module is one operator.
"""
