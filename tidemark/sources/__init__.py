"""Where tables are read from and written to."""

from .base import Catalog, open_catalog
from .jdbc import JdbcCatalog
from .parquet import ParquetCatalog
from .warehouse import WarehouseCatalog

__all__ = ["Catalog", "JdbcCatalog", "ParquetCatalog", "WarehouseCatalog", "open_catalog"]
