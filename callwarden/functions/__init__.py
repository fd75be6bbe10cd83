"""Scalar building blocks: pure Column -> Column functions, all evaluated in the JVM."""
