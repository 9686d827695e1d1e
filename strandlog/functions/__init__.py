"""Column functions: strings, numbers, times and values."""
