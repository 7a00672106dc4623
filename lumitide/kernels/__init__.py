"""Whole-picture kernels in numpy, on arrays of shape (..., height, width, channels) of 8 bits."""
