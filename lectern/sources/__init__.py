"""Readers and writers: EPUB archives, rule files, output trees."""
