"""Operators for preparing training data: similarity, clusters, subsets, samples, packing, mixing, quality."""
