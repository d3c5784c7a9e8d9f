"""Whole questions: one lazy plan each, composed from the operators."""
