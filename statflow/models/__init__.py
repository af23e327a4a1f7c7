"""Fitted models."""
