"""The sources layer."""
