"""Readers and writers: packages, XML, HTML."""
