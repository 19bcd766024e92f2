"""Tributary: plans."""
