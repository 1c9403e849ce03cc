"""Training-data operators: ten corpus operators, each a DataFrame -> DataFrame function."""
