"""Whole coverage reports as lazy plans."""
