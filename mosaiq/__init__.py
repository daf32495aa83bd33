"""mosaiq: panorama tile analytics and training-data preparation on PySpark."""

__version__ = "0.1.0"
