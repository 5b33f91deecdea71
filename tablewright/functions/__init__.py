"""Column functions and feature encoders."""
