"""Column functions: millisecond grammar, sampling, wire format, identifiers and rules."""
