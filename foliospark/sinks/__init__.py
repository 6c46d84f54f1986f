"""Markdown, chapters and reports."""
