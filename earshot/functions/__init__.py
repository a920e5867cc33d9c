"""Column functions: geometry, physics, text. Built from Spark's own functions alone, so that they stay in generated code."""
