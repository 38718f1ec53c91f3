"""Composed retrieval plans and their configuration."""
