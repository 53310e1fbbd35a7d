"""Readers and normalisers of archives, exports, provider responses and files."""
