"""The same models over streams."""
