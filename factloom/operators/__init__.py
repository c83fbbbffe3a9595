"""Fact-analysis operators: DataFrames of facts in, DataFrames of derived facts out."""
