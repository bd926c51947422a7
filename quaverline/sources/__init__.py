"""Adapters that read tables and files as series."""
