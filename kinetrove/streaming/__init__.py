"""Analyses of trajectories that still grow."""
