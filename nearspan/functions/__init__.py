"""Scorers, encoders and alignments, as kernels over batches, as columns and as SQL functions."""
