"""Document queries, pipelines and updates over Spark DataFrames."""

from .database import Client, ClientSession, Database
from .errors import CompileError, DocError, DuplicateKey, WriteRefused
from .operators.pipeline import aggregate
from .sources.documents import ObjectId

__all__ = ["Client", "ClientSession", "CompileError", "Database", "DocError", "DuplicateKey", "ObjectId", "WriteRefused", "aggregate"]
