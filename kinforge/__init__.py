"""Multiplying sets of related tables while keeping them loadable, and comparing the copies with their originals."""
