"""Column functions and NumPy kernels for geometries."""
