"""Sources of the read-denoising engine."""
