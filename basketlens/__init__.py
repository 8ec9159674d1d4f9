"""basketlens: comparing collections of ingredient-list documents on Spark."""
