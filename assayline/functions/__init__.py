"""Column functions: finite values, array algebra, seeds and rounding, all evaluated in the JVM."""
