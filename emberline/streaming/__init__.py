"""The same decisions and joins over streams."""
