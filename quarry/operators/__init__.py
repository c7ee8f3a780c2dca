"""Relational operators as DataFrame functions; Catalyst picks the physical strategy."""
