"""Document retrieval and answer-context engine on PySpark."""
