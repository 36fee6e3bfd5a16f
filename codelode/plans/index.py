"""Building and maintaining the index of one project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import code as C
from codelode.operators import keywords as K


def build(listing: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
    """All tables of a project from (rel_path, extension, size_bytes, last_modified) and (rel_path, text)."""
    body = texts.where("trim(text) <> ''").select(F.lit("").alias("project_id"), "rel_path", "text")
    files = listing.select("rel_path", "extension", "size_bytes", "last_modified")
    symbols = C.extract_symbols(body)
    imports = C.resolve_imports(C.extract_imports(body).drop("at"), body)
    found = C.categories(symbols).unionByName(C.route_categories(body, symbols))
    return {
        "listing": files,
        "files": files.join(body.select("rel_path"), "rel_path", "left_semi"),
        "texts": body.select("rel_path", "text"),
        "chunks": C.chunk_texts(body, symbols),
        "symbols": symbols,
        "keyword_files": K.inverted_index(body, ["rel_path"], "text"),
        "file_imports": imports,
        "symbol_categories": found,
    }


def changed(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are new or whose size or time isn't that of the index; an old time stamp doesn't hide a new file."""
    old = files.select("rel_path", F.col("size_bytes").alias("_s"), F.col("last_modified").alias("_m"))
    both = listing.join(old, "rel_path", "left")
    return both.where(F.col("_s").isNull() | (F.col("_s") != F.col("size_bytes")) | (F.col("_m") != F.col("last_modified"))).drop("_s", "_m")


