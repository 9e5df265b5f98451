"""tracelode: analytics over logged API-call traces, session documents and text corpora, built on PySpark."""

__version__ = "0.1.0"
