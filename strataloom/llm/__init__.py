"""Operators for training data of language models: top-n, quantiles, leakage, mixtures, redaction."""
