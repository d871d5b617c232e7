"""Operators of a training-data pipeline: sharding, tokenizers, classifiers, deduplication and decontamination."""
