"""Operators: criteria (wide and long), codelist curation, definition
catalog, learned phenotypes and trace-based clustering."""
