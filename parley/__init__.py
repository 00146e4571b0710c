"""parley: dialogue-corpus analytics as Spark DataFrame plans."""
