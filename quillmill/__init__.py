"""quillmill: long documents, levelled readings and their task queue as Spark DataFrame operators."""

__version__ = "0.1.0"
