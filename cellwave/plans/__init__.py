"""Composition of operators into one lazy plan."""
