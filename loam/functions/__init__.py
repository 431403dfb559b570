"""Column builders: text measures, folds over arrays, vectors, curve smoothing, lexicons."""
