"""corvine: vector analytics and document retrieval expressed as Spark plans."""

__version__ = "0.1.0"
