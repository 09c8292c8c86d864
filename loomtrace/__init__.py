"""loomtrace: Spark jobs over agent-session traces and training corpora."""
