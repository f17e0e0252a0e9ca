"""Corpus operators for training data, each a set of DataFrame functions."""
