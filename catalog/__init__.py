"""Registered queries over the provided tables, with their SQL twins where SQL can say the same."""
