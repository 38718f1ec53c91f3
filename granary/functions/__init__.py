"""Column-to-Column functions, all JVM-side."""
