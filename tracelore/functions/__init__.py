"""Column functions and tree functions."""
