"""Tables as corpora: path, size, modified, content and the columns that a file scan would give."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftfold.functions import exprs


def corpus_of_documents(docs: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return as_corpus(docs, path, F.col("text"), F.timestamp_seconds("doc_id"), F.col("doc_id"))


def corpus_of_pages(pages: DataFrame) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://", "/")
    return as_corpus(pages, path, F.col("html"), F.timestamp_seconds("page_id"), F.col("page_id"))


def corpus_of_benchmark(items: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/benchmark/"), F.col("item_id").cast("string"), F.lit(".txt"))
    return as_corpus(items, path, F.col("text"), F.timestamp_seconds("item_id"), F.col("item_id"))


def as_corpus(df: DataFrame, path: Column, text: Column, modified: Column, id_: Column) -> DataFrame:
    content = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return df.select(
        id_.alias("id"), path.alias("path"), F.octet_length(content).cast("long").alias("size"), modified.alias("modified"), content.alias("content")
    ).withColumns({"depth": exprs.depth(F.col("path")), "hidden": exprs.is_hidden(F.col("path")), "extension": exprs.extension(F.col("path"))})


def union_roots(*roots: DataFrame) -> DataFrame:
    """Several roots as one corpus."""
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
