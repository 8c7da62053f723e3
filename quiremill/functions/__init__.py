"""Column functions: text, units and colours."""
