"""Helpers for building plans over frames of unknown columns."""
