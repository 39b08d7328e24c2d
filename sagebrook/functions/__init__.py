"""Column functions and the rule lists that they take as parameters."""
