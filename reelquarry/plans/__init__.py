"""The plans layer."""
