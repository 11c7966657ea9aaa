"""Registered queries: fixture views, plans and their SQL oracles."""
