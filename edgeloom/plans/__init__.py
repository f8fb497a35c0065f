"""Folds, permutations, samples and bootstrap draws as tables."""
