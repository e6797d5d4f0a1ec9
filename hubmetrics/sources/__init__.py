"""Readers for landed files and writers for reports and features."""
