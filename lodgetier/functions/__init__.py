"""Column -> Column functions; all stay inside generated JVM code."""
