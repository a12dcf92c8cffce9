"""Readers, writers and small registry tables."""
