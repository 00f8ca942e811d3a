"""Readers and writers: archive files, trees, text lists."""
