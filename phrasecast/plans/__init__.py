"""The four flows end to end."""
