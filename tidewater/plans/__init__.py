"""Declarative strategies compiled to columns, and studies made of several operators."""
