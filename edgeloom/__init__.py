"""PySpark engine for connectome-based predictive modelling and permutation inference."""
