"""The same logic over streams."""
