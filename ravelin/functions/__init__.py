"""Column expressions and Arrow functions the operators are made of."""
