"""Column expressions.  They stay in the JVM: no function of this package runs Python per row."""
