"""Operators for preparing language-model training data, at the scale of the whole corpus."""
