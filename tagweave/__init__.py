"""A Spark-native engine for component graphs of piping diagrams and their cross-checks against procedures."""
