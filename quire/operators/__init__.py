"""Operators over records, pages, trees, chunks and answers."""
