"""Readers, writers and adapters for the tables the operators take."""
