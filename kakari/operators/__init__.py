"""The stages and analyses, each a function of DataFrames or Columns."""
