"""Column expressions: no row of data leaves the JVM in this package."""
