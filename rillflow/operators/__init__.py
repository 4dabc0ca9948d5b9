"""Batch operators over transaction events."""
