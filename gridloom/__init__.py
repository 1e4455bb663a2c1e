"""gridloom: spreadsheet-style and document analytics on Spark DataFrames."""
