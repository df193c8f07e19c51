"""Question answering over document collections as lazy Spark plans."""
