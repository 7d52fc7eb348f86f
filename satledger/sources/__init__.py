"""Readers: landed upstream pages, the invoice store, Markdown, dimensions."""
