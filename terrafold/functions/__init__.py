"""Column-expression functions. None of them leaves the JVM."""
