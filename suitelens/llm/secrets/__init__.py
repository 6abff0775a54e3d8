"""Credentials in source files, configuration and settings."""
