"""Template retrieval, ordered-point geometry and score-panel inference as Spark DataFrame operators."""
