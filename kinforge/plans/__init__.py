"""Specs, their graph, and the runs that put operators together."""
