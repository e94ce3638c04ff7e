"""Image kernels: numpy alone, one image at a time, no Spark."""
