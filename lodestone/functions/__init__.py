"""Scalar functions: units, text analysis, linear algebra, bit operations on binaries."""
