"""Joins, aggregates and ordered operators, all safe against one dominant key."""
