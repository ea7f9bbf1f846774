"""lodeseek: hybrid (lexical + vector) retrieval and data processing, native to PySpark.

The package is pickled by value, so Python workers need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

from lodeseek.operators.builders import LexicalIndexBuilder, VectorIndexBuilder  # noqa: E402
from lodeseek.sources import Index, IndexBuilder, IndexReader, SearchResult, read_documents  # noqa: E402

__all__ = ["Index", "IndexBuilder", "IndexReader", "LexicalIndexBuilder", "SearchResult", "VectorIndexBuilder", "read_documents"]
