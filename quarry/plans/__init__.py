"""Iteration: frontier loops whose state is written to the shared folder each round."""
