"""Plan shapes shared by the operators: bounded slices, spread lookups, top-k, tails."""
