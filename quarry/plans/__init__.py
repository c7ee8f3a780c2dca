"""Names, types, settings, statements and plan shapes."""
