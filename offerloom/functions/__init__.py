"""Column-to-column building blocks; all of them stay inside the JVM."""
