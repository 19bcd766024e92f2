"""Tributary: functions."""
