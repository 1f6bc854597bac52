"""emberline: retroactive trace retention and corpus preparation on PySpark."""
