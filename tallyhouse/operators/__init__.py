"""Relational operators: upserts, reaping, hierarchy, inference, containment."""
