"""Statistics of ordered event sequences, as DataFrame functions."""
