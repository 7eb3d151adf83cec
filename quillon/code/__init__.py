"""Analysis of Python sources: one pass a file from text to rows."""
