"""Column -> Column functions, all inside the JVM unless a docstring says otherwise."""
