"""Readers for the domain tables."""
