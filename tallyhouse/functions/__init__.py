"""Column functions; everything here stays inside the JVM."""
