"""Registered queries, by kind of operator."""
