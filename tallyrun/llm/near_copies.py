"""Near copies among documents: candidates of SimHash tries and MinHash bands, each verified by exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import paragraphs, simhash
from .common import slices, texts_of, written
from .components import components

#: 20 bands of 4 rows: of pairs at 0.8 all but 1 in 38,000 meet in a band. Texts are few beside paragraphs.
BANDS, ROWS = 20, 4
#: Members of a group that one task compares with another such lot; whole texts have large sets.
LOT = 300


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over texts: the hash of the words (0 without any) and the SimHash of each."""
    for batch in slices(batches, size=4 << 20):
        texts = texts_of(batch)
        parts = paragraphs.parts_of(texts, paragraphs.whole)
        ps = np.zeros(len(texts), np.int64)
        ps[parts.text] = parts.p
        fps = np.array([simhash.fingerprint(x, paragraphs.WIDTH) for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(ps), pa.array(fps)], ["doc_id", "tag", "p", "fp"])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = paragraphs.SIMILAR, budget: int = 2, lot: int = LOT) -> DataFrame:
    """One row per document: (doc_id, component), component a number that near copies share.

    Documents link if their words are equal (A-Z lowered, blanks aside) or their sets of
    five-word shingles have a Jaccard similarity of ``similar`` or more; a component is all
    that is reachable over links. Null texts count as empty; texts without words are equal.

    Candidates are the groups of the SimHash tries (fingerprints of five-word shingles, links
    at ``budget`` bits) and of the MinHash bands. At a similarity of 0.8 fingerprints differ by
    about 10 bits, and a budget that reaches those leaves runs of 5 bits, which is every pair
    in a few tries; the bands find these pairs. Nothing links without the exact comparison.
    """
    last = F.lit((1 << 63) - 1)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = written(picked.mapInArrow(_prints, "doc_id long, tag long, p long, fp long"), "prints")
    place = F.struct(F.coalesce("doc_id", last).alias("doc"), F.lit(0).alias("para"))
    firsts = written(found.groupBy("p").agg(F.min(place).alias("first"), F.min_by("tag", place).alias("tag")), "firsts")

    tries = components(simhash.links(written(found.select("fp").distinct(), "nodes"), budget)).select(F.col("node").alias("fp"), "label")
    alike = written(found.select("fp", "p").distinct().join(tries, "fp", "left").select(F.xxhash64(F.lit("trie"), F.coalesce("label", "fp")).alias("key"), "p").distinct(), "alike")
    alike = alike.join(alike.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")
    members = written(alike.select("key", "p").union(paragraphs.banded(picked, paragraphs.whole, BANDS, ROWS)), "members")
    labels = paragraphs.linked(picked, firsts, members, paragraphs.whole, similar, lot)
    return found.join(labels, "p", "left").select("doc_id", F.coalesce("label", "p").alias("component"))
