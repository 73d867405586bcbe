"""Scalar functions: each takes Columns and returns a Column, evaluated inside the JVM."""
