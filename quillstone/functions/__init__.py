"""Scalar functions: tokenizers, stop words, stemmer, posting codec, scores."""
