"""Shingles, minhash signatures, banding, and cosine similarity of dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.ordered import changes, with_dense_ids, with_dense_rank
from quernstone.functions.text import clean_body, exploded_shingles, shingles
from quernstone.session import materialised

PRIME = 110_641
CHUNK = 1024  # rows whose hash values are made at once, so that they stay in the processor's cache


def coefficients(n: int = 100, prime: int = PRIME) -> list[tuple[int, int]]:
    """Fixed hash coefficients from a linear congruential rule: a in [1, prime), b in [0, prime)."""
    out, x = [], 12_345
    for _ in range(n):
        a = x = (x * 1_103_515_245 + 12_345) % 2**31
        b = x = (x * 1_103_515_245 + 12_345) % 2**31
        out.append((a % (prime - 1) + 1, b % prime))
    return out


def shingle_pairs(docs: DataFrame, k: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct ``doc, shingle``: the presence matrix in sparse form."""
    words = F.split(clean_body(F.col(text)), " ")
    return docs.select(doc, F.explode(F.array_distinct(shingles(words, k))).alias("shingle"))


def shingle_ids(pairs: DataFrame) -> DataFrame:
    """``shingle, shingle_id``: 1-based ids in sorted order, without a single-task sort."""
    return with_dense_ids(pairs.select("shingle").distinct(), ["shingle"], "shingle_id")


def shingle_matrix(pairs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``shingle_id, doc`` of every 1 in the presence matrix. Pairs may repeat; they are read twice, so they are made once."""
    return with_dense_rank(materialised(pairs.select("shingle", doc), "shingle-pairs"), "shingle", "shingle_id")


def document_matrix(docs: DataFrame, k: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``shingle_matrix`` of ``docs``, whose pairs are told apart only where they are sorted."""
    return shingle_matrix(exploded_shingles(docs.select(doc, F.col(text).alias("_text")), F.split(clean_body(F.col("_text")), " "), k).drop("_text"), doc)


def whole_signatures(matrix: DataFrame, n: int = 100, prime: int = PRIME, doc: str = "doc_id") -> DataFrame:
    """``doc, s``: the array of the ``n`` least (a x + b) mod ``prime`` over a document's shingle ids.

    A sum depends on x mod ``prime`` alone, so that is what goes to the document, once for each pair; the ``n`` values are first
    made where all of a document's ids are. ``prime`` is below 2^31.
    """
    a, b = (np.array(x, dtype=np.int64) for x in zip(*coefficients(n, prime), strict=True))
    dealt = matrix.select(doc, F.pmod("shingle_id", F.lit(prime)).cast("int").alias("x")).repartition(doc).sortWithinPartitions(doc)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last, open_ = None, None, None  # the document whose rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, x = batch.column(0), batch.column(1).to_numpy().astype(np.int64)
            new = changes(docs, last).to_numpy(zero_copy_only=False)
            new[0] |= open_ is None
            starts = np.union1d([0], np.flatnonzero(new))
            low = np.full((len(starts), n), prime, dtype=np.int64)
            ends = np.append(starts[1:], len(x))
            for lo in range(0, len(x), CHUNK):
                hi = min(lo + CHUNK, len(x))
                here = np.flatnonzero((starts < hi) & (ends > lo))
                v = x[lo:hi, None] * a + b
                v -= v // prime * prime
                low[here] = np.minimum(low[here], np.minimum.reduceat(v, np.maximum(starts[here] - lo, 0), axis=0))
            if open_ is not None and not new[0]:
                low[0] = np.minimum(low[0], open_)
            elif open_ is not None:
                yield _signature_batch(name, open_[None], doc)
            if len(starts) > 1:
                yield _signature_batch(docs.take(pa.array(starts[:-1])), low[:-1], doc)
            name = last = docs[-1:]
            open_ = low[-1]
        if open_ is not None:
            yield _signature_batch(name, open_[None], doc)

    return dealt.mapInArrow(least, dealt.select(doc, F.array(F.lit(0).cast("long")).alias("s")).schema)


def _signature_batch(docs: pa.Array, values: np.ndarray, doc: str) -> pa.RecordBatch:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(offsets, values.ravel())], [doc, "s"])


def signatures(matrix: DataFrame, n: int = 100, prime: int = PRIME, doc: str = "doc_id") -> DataFrame:
    """``doc, hash_no, min_hash``: ``whole_signatures`` with a row for each value."""
    return whole_signatures(matrix, n, prime, doc).select(doc, F.posexplode("s").alias("hash_no", "min_hash"))


def _keyed(signature: DataFrame, doc: str) -> DataFrame:
    """``doc, s, key``: a document's values in order of ``hash_no`` and the SHA-256 of all its signature, from either form of it."""
    if "s" in signature.columns:
        return signature.withColumn("key", _digest(F.col("s").cast("array<string>")))
    whole = signature.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("hash_no", "min_hash"))).alias("v"))
    return whole.select(doc, F.col("v.min_hash").alias("s"), _digest(F.concat(F.col("v.hash_no").cast("array<string>"), F.col("v.min_hash").cast("array<string>"))).alias("key"))


def _digest(values: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(values, "_", "?"), 256))


def lsh_classes(signature: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, class_id`` of every document: the least id with the same signature, which stands for it in ``lsh_pairs``.

    ``signature`` is what ``signatures`` or ``whole_signatures`` gives. Only the key of a signature is written and shuffled.
    """
    keyed = materialised(_keyed(signature, doc).select(doc, "key"), "signature-keys")
    return keyed.join(keyed.groupBy("key").agg(F.min(doc).alias("class_id")), "key").select(doc, "class_id")


def lsh_pairs(signature: DataFrame, rows_per_band: int = 1, threshold: float = 0.01, doc: str = "doc_id", of_bands: bool = False) -> DataFrame:
    """Candidate pairs ``doc_a < doc_b`` with their common buckets, if those are at least ``threshold`` x documents.

    That basis is the reference's and grows with the table: two documents have at most as many buckets in common as there are bands, so
    past ``bands / threshold`` documents no pair can reach it, and then none is formed. With ``of_bands`` the threshold is a
    share of the bands instead. Documents with one signature are one class and stand as
    its least id, so copies are not paired with each other; ``lsh_classes`` has the members.
    """
    keyed = materialised(_keyed(signature, doc), "signatures")
    classes = keyed.join(keyed.groupBy("key").agg(F.min(doc).alias(doc)), doc, "left_semi").select(doc, "s")
    bands = F.ceil(F.size("s") / rows_per_band)
    size = keyed.agg(F.max(bands).alias("bands"), F.count(F.lit(1)).alias("docs"))
    least = F.broadcast(size.select("bands", (threshold * F.col("bands" if of_bands else "docs")).alias("least")))  # one row
    met_somewhere = classes.crossJoin(least).where("bands >= least").select(doc, "s")
    buckets = F.transform(F.sequence(F.lit(0), bands.cast("int") - 1), lambda i: F.array_join(F.slice(F.col("s").cast("array<string>"), i * rows_per_band + 1, rows_per_band), "_"))
    long = met_somewhere.select(doc, F.posexplode(buckets).alias("band", "bucket"))
    a, b = long.withColumnRenamed(doc, "doc_a"), long.withColumnRenamed(doc, "doc_b")
    met = a.join(b, ["band", "bucket"]).where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.count(F.lit(1)).alias("common"))
    return met.crossJoin(least).where("common >= least").select("doc_a", "doc_b", "common")


def cosine_to(vectors: DataFrame, target: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cosine of every vector with the target's; null where a norm is 0."""
    one = vectors.where(F.col(key) == target).select(F.col(vector).cast("array<double>").alias("_t")).limit(1)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    v, t = F.col(vector).cast("array<double>"), F.col("_t")
    return vectors.crossJoin(F.broadcast(one)).select(key, F.try_divide(dot(v, t), F.sqrt(dot(v, v)) * F.sqrt(dot(t, t))).alias("cosine"))
