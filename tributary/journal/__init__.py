"""Tributary: journal."""
