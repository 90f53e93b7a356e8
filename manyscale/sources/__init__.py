"""Readers and writers for frames, labels and fitted models."""
