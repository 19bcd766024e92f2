"""Tributary: streaming."""
