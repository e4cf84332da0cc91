"""Column-level building blocks: types, arithmetic with NA rules, coercions, positions."""
