"""Configuration and catalogs."""
