"""Operators of the read-denoising engine."""
