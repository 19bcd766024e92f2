"""Tributary: sources."""
