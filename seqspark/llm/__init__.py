"""Operators of a training-data pipeline: tokens, language models, archives, mixing, search and filtering."""
