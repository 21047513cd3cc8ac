"""Plans of the read-denoising engine."""
