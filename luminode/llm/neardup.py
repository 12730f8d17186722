"""Near-duplicate documents: sets of word shingles, linked as operators.similar does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminode.llm.common import free_names, stored
from luminode.llm.words import pieces, split
from luminode.operators.similar import _A, SIMILARITY, link_classes, mix, signatures


def shingles(width: int):
    """A function of texts: each one's distinct shingles of `width` words, as sorted 64-bit hashes.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """

    def chain(keys: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(keys) - size + 1, np.uint64)
        for k in range(size):
            out = mix(out * _A + keys[k : k + len(out)] + _A)
        return out

    def sets_of(texts: pa.Array) -> list[np.ndarray]:
        out = []
        for part in pieces(texts):
            words = split(part)
            keys = words.keys()
            grams = chain(keys, width) if len(keys) >= width else keys[:0]
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                out.append(np.unique(grams[a : b - width + 1]) if b - a >= width else chain(keys[a:b], b - a) if b > a else keys[:0])
        return out

    return sets_of


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 2, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Shingles are `width` consecutive words (blank-separated, A-Z in lower case), or the whole
    sequence of a shorter text. Documents whose sets satisfy 100 * intersection >= similarity *
    union are linked. Documents with an equal set form a class and are linked through it. Empty
    and null texts have no shingles and are linked with nothing. Rows that repeat an id belong to
    that document: each is listed with the id's component. A null id is linked with nothing, has
    a null component and is kept. Only the two named columns are read.
    """
    sets_of = shingles(width)
    signed = stored(signatures(docs, sets_of, doc_id, text), "signatures")
    sets = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = stored(sets.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "classes")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    linked = link_classes(classes, texts, sets_of, similarity)
    member = classes.join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = signed.join(member, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The documents of which near_duplicates keeps the id; of rows with equal id and text one stays.

    Rows with a null id all stay. All columns are kept as they are, whatever their names; of repeated
    rows with other columns that differ an arbitrary one stays.
    """
    id, body = free_names(docs.columns, "id", "text")
    kept = near_duplicates(docs, doc_id, text, width, similarity).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id)).distinct()
    named = docs.where(F.col(doc_id).isNotNull())
    chosen = named.join(kept, named[doc_id].cast("long") == kept[id], "left_semi")
    # repeated rows meet by id and a hash of the text
    once = chosen.withColumn(body, F.xxhash64(text)).dropDuplicates([doc_id, body]).drop(body)
    return once.unionByName(docs.where(F.col(doc_id).isNull()))
