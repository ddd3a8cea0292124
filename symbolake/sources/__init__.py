"""Readers of source trees and of stored JSON documents."""
