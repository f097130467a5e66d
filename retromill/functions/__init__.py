"""Column functions and Arrow kernels on sequences."""
