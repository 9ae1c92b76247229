"""Reading and writing question sets, labels, variants, outputs and images."""
