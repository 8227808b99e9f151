"""Operators over racing views."""
