"""Column expressions: JSON text, lists, maps and names. All run JVM-side."""
