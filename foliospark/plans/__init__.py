"""Whole runs: documents in, Markdown, chapters and warnings out."""
