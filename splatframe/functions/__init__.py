"""Column functions: vectors, Gaussians, intersection predicates."""
