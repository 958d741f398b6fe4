"""quadrille: spreadsheet and grid analytics as Spark DataFrames."""
