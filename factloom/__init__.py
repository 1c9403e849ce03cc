"""factloom: relational operators over fact tables, and corpus operators, on Spark DataFrames."""
