"""Readers: files and tables in, DocSet out."""
