"""The query language: text to syntax tree and back."""
