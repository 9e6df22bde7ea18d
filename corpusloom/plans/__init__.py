"""Queries over the test tables; importing a module registers its queries."""
