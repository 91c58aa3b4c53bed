"""Corpus-preparation operators: ten stand-alone components for training-data pipelines.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
