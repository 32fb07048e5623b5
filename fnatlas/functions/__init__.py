"""Column expressions: labels and features of code, vector arithmetic, embedders."""
