"""Column expressions and the ordered-scan kernels shared by the operators."""
