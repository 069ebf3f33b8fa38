"""heliograph: a media-catalog analytics engine expressed as PySpark DataFrame transformations."""

__version__ = "0.1.0"
