"""Column functions: Column in, Column out, evaluated in the JVM."""
