"""Operators of a training-data pipeline: near copies, search, mixing, quality, secrets, tokens, licences, language models."""
