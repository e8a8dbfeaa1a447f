"""Streams into catalog tables."""
