"""assayline: a Spark-native engine for multivariate calibration studies."""

__version__ = "0.1.0"
