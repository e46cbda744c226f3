"""Readers and writers of the text layers, models and options."""
