"""Analytics over collections of source files and text, as Spark DataFrame jobs."""
