"""Training-data operators. Nothing outside this folder imports it, bar a guarded registration."""
