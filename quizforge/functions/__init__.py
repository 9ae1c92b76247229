"""Column expressions: keys, text parsing, ordered folds."""
