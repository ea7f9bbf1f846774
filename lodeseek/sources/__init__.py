"""Reading documents, and storing and opening indexes."""

from lodeseek.sources.index import Index, IndexBuilder, IndexReader, SearchResult
from lodeseek.sources.parquet import read_documents

__all__ = ["Index", "IndexBuilder", "IndexReader", "SearchResult", "read_documents"]
