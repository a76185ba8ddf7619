"""Codecs, identities and pointers."""
