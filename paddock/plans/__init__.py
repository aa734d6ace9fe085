"""Compositions of operators: derived tables, questions, cleaning runs, uploads, views."""
