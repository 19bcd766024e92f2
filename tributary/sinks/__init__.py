"""Tributary: sinks."""
