"""Registered queries: each module below adds those of its area to the registry."""
