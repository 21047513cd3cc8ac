"""Functions of the read-denoising engine."""
