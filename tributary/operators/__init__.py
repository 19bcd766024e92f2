"""Tributary: operators."""
