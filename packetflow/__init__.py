"""packetflow: a PySpark-native engine for scanned-document packets."""

__version__ = "0.1.0"
