"""Checks of documents and of what was rendered of them: (doc_id, page_number, warning)."""
