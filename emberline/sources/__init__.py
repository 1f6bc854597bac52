"""Where spans come from and where kept ones go."""
