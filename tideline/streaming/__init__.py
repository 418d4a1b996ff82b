"""Applying fitted models to streams."""
