"""Readers, sinks and fixture views."""
