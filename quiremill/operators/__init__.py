"""Relational operators over nodes, tables, styles, chunks and fills."""
