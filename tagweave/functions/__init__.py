"""Column functions: vocabulary, text, geometry. All stay in the JVM."""
