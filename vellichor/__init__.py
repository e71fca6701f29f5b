"""Spark-native document analytics and retrieval.

The core (operators, sources, functions, plans, streaming) never imports the
optional subpackage with the corpus-preparation operators; deleting that
folder leaves everything else working.
"""

__version__ = "0.1.0"
