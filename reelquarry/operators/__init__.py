"""The operators layer."""
