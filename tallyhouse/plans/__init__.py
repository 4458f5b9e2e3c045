"""Queries, transforms and the build that ties the operators together."""
