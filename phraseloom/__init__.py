"""Phraseloom: text annotation, multi-word-expression detection and corpus
data processing as Spark DataFrame operators."""

__version__ = "0.1.0"
