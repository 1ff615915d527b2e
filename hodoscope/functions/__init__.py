"""Column expressions and driver-side numerics the operators are built from."""
