"""Column-returning functions on vectors, urls, versions and text."""
