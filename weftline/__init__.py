"""Weftline: an analytics engine on PySpark for the metadata, text and call graphs of code repositories."""
