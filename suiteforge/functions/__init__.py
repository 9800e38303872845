"""Column -> Column functions: text cleanup, JSON salvage, output comparison, hashing."""
