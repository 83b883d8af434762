"""swatchbook: catalogue-to-training-set jobs on the public Spark API."""

__version__ = "0.1.0"
