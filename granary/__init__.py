"""granary: a PySpark engine for governed facts from messy tables."""
