"""Readers of files and configuration."""
