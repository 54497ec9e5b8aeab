"""Operators for large training corpora. Nothing else in the library imports this subpackage."""

import os

# small matrix products: one thread per task is faster than several
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
