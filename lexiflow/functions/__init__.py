"""Column functions: text, numbers, colours and geometry."""
