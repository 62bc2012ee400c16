"""Column functions. Every one returns a built-in expression, so rows stay in the JVM."""
