"""offerlens: price and assortment analytics, and corpus preparation, as PySpark operators."""
