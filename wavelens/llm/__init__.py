"""Operators of a training-data pipeline: deduplication, tokenisation, mixing,
language and quality models, token files and nearest neighbours."""
