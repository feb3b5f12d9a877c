"""Operator 3, near-duplicate classes: consistent weighted sampling, bands, weighted Jaccard.

1. Document frequencies of words, over all documents; words in at least
   ``RARE`` of them get their own idf, all others the same. That table has at
   most (mean distinct words per document) / RARE rows.
2. One pass gives each text a digest of its words, its weight, its number of
   shingles and ``BANDS`` numbers of ``ROWS`` samples each (:mod:`weighted_minhash`);
   ``PLAIN`` of the bands sample shingles without their weights. Texts of equal
   words are one text from here on, known by its smallest doc_id.
3. Texts that share a band's number are a bucket. In each bucket every text is
   compared with the one that sits in the fullest buckets (later with the first
   ``PIVOTS`` of them): in a group of copies that is the text the others were
   made from. Pairs whose weights and numbers of shingles both differ too
   much to reach ``SIMILARITY`` are left out; of the others the weighted Jaccard
   similarity is worked out from the whole texts. A pair is a link when it
   reaches ``SIMILARITY``, or when the same shingles do without their weights, so
   that weighting never loses a copy. Classes are the connected components.
4. Buckets that still hold several classes go on: up to ``SMALL`` texts, every
   pair of different classes is compared; the texts of larger ones are compared
   with ``PIVOTS`` texts of the bucket, and after that joined by their rarest
   shingles (:func:`_exact_pairs`), which finds every pair of two classes that
   reaches ``SIMILARITY``, whatever the size of its group. A common shingle joins
   as many pairs as its texts allow only where their weights from it on can reach
   the similarity, so siblings whose own parts rule it out cost no comparison.

In buckets of up to ``SMALL`` texts, pairs that agree in ``AGREE`` bands or more
are compared: of similarity s, each band agrees with probability s**ROWS, so
0.997 of the pairs at 0.8 with and without weights are, and 0.9998 at 0.86; of
pairs at 0.3, which share a passage, 0.008. Where the two similarities part, the
bands of the one that reaches 0.8 count: a text whose body stands twice in its copy
(0.5 by weight, 0.95 without) is compared in 0.98 of all cases.

Defined cases: NULL texts and texts without words are no one's copy; texts of
fewer than five words are compared whole; rows of one doc_id are one document;
rows without doc_id are documents of their own by text and have the class id of
their class's smallest doc_id, NULL if there is none; an empty table gives an
empty result; extra columns are ignored, :func:`distinct_documents` keeps them.

Recovery and size: signatures, buckets, candidate texts, links and every round
of labels are written to the shared folder. Groups are counted with map-side
parts; the joins read written tables, so hot keys can be split. Only the bounded
table of frequencies and counts reach the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranking import top_per_group
from .common import kept_table, slices, small_side
from .components import components
from .weighted_minhash import Sampler, Shingler, similarity, weights_of, word_hash, words_of

SIMILARITY = 0.8
BANDS = 16
PLAIN = 4
ROWS = 4
AGREE = 2
PIVOTS = 4
RARE = 0.01
SMALL = 64
SLICE = 3 << 20
SLOTS = 1 << 18
SLACK = 1e-6


def _text_rows(docs: DataFrame) -> DataFrame:
    """rid: doc_id, or a negative number by text where it is NULL."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    unnamed = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseOR(F.lit(-(1 << 63)))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, unnamed).alias("rid"), text.alias("text"))


def frequent_words(rows: DataFrame, rare: float = RARE) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes and idf of the words in at least ``rare`` of the documents, and the idf of all others."""

    def counted(batches):
        for batch in slices(batches):
            seen: dict[bytes, int] = {}
            for text in batch.column("text").to_pylist():
                for word in set(words_of(text)):
                    seen[word] = seen.get(word, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([word_hash(w) for w in seen], np.uint64).view(np.int64)), pa.array(list(seen.values()), pa.int64())],
                names=["word", "docs"],
            )

    total = rows.count()
    held = (
        rows.select("text").mapInArrow(counted, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
        .where(F.col("docs") >= max(1.0, rare * total)).orderBy("word").toPandas()
    )
    return held["word"].to_numpy(np.int64).view(np.uint64), np.log(max(total, 1) / held["docs"].to_numpy(float)), math.log(1 / rare)


def signatures(rows: DataFrame, frequencies, bands: int, rows_per_band: int) -> DataFrame:
    """doc_id, rid, digest (NULL for a text without words), weight, shingles, bands."""

    def signed(batches):
        shingles, sample = Shingler(*frequencies), Sampler(bands, rows_per_band, min(PLAIN, bands // 4))
        for batch in slices(batches, size_bytes=SLICE):
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            keys, levels, counts = shingles(texts)
            owner = np.repeat(np.arange(len(texts)), counts)
            weight = np.bincount(owner, weights_of(levels), len(texts))
            numbers = sample(keys, levels, counts)
            digest = [hashlib.blake2b(b" ".join(t), digest_size=16).digest() if t else None for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("rid"), pa.array(digest, pa.binary()), pa.array(weight, pa.float64()),
                    pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(numbers.ravel())),
                ],
                names=["doc_id", "rid", "digest", "weight", "shingles", "bands"],
            )

    return rows.mapInArrow(signed, "doc_id long, rid long, digest binary, weight double, shingles int, bands array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, frequencies) -> DataFrame:
    """a, b, similarity, plain of every pair, worked out from the whole texts."""

    def measured(batches):
        shingles = Shingler(*frequencies)
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            found, known = [], {}
            for start in range(0, len(left), 256):
                chunk = [*left[start : start + 256], *right[start : start + 256]]
                distinct = {t: k for k, t in enumerate(dict.fromkeys(chunk))}
                keys, levels, counts = shingles([words_of(t) for t in distinct])
                ends = np.cumsum(counts)
                known = {t: (keys[ends[k] - counts[k] : ends[k]], levels[ends[k] - counts[k] : ends[k]]) for t, k in distinct.items()}
                found += [similarity(*known[a], *known[b]) for a, b in zip(left[start : start + 256], right[start : start + 256])]
            weighted, plain = ([x[k] for x in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(weighted, pa.float64()), pa.array(plain, pa.float64())],
                names=["a", "b", "similarity", "plain"],
            )

    one = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    other = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(one, "b").join(other, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(measured, "a long, b long, similarity double, plain double")


def _near(least: float) -> Column:
    """Whether two weights allow the similarity, or two numbers of shingles do without weights."""
    enough = lambda c, share: F.least(f"{c}_1", f"{c}_2") >= share * F.greatest(f"{c}_1", f"{c}_2")
    return enough("weight", least - SLACK) | enough("shingles", least)


def _pairs(members: DataFrame, least: float, agree: int, pivots: int) -> DataFrame:
    """a, b: pairs to compare. Every pair of a narrow bucket, in a wide one each text with the most famous ones.

    Pairs of one class, of too different weights, or of too few equal bands are left out.
    """
    wide, narrow = members.where(~F.col("narrow")), members.where("narrow")
    side = lambda df, n: df.select("bucket", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "weight", "shingles", "bands", "label")])
    pivot = side(top_per_group(wide, ["bucket"], [F.desc("fame"), F.asc("node")], pivots), 2)
    found = side(wide, 1).join(pivot, "bucket").unionByName(
        side(narrow, 1).join(side(narrow, 2), "bucket").where("node_1 < node_2")
    )
    equal = F.size(F.filter(F.zip_with("bands_1", "bands_2", lambda x, y: x == y), lambda same: same))
    return (
        found.where((F.col("label_1") != F.col("label_2")) & _near(least) & (equal >= agree))
        .select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b"))
        .distinct()
    )


def _slot_counts(texts: DataFrame, frequencies) -> np.ndarray:
    """How many shingles of all ``texts`` fall into each of ``SLOTS`` slots."""

    def counted(batches):
        shingles, seen = Shingler(*frequencies), np.zeros(SLOTS, np.int64)
        for batch in slices(batches, size_bytes=SLICE):
            keys, _, _ = shingles([words_of(t) for t in batch.column("text").to_pylist()])
            seen += np.bincount((keys % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(seen[slot])], names=["slot", "n"])

    held = texts.select("text").mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[held["slot"].to_numpy()] = held["n"].to_numpy()
    return out


def _exact_pairs(open_nodes: DataFrame, texts: DataFrame, frequencies, least: float) -> DataFrame:
    """a, b: of the texts of ``open_nodes`` (node, label) every pair of two classes that can reach ``least``.

    Shingles have one order for all texts, rare ones first. Two texts that reach
    ``least`` share a shingle among the first of each, up to 1 - ``least`` of its
    weight, and from their first shared shingle on both must hold as much as the
    similarity needs; the same holds of numbers of shingles instead of weights.
    That is so for any order; the counts by slot only make the lists short.
    """
    open_texts = kept_table(texts.join(small_side(open_nodes), "node"), "open-texts")
    slots = _slot_counts(open_texts, frequencies)

    def first(batches):
        shingles = Shingler(*frequencies)
        for batch in slices(batches, size_bytes=SLICE):
            keys, levels, counts = shingles([words_of(t) for t in batch.column("text").to_pylist()])
            owner = np.repeat(np.arange(len(counts)), counts)
            seen = slots[(keys % np.uint64(SLOTS)).astype(np.int64)]
            order = np.lexsort((keys, seen, owner))
            keys, seen, weight = keys[order], seen[order], weights_of(levels[order])
            total = np.bincount(owner, weight, len(counts))
            upto, start = np.cumsum(weight), np.cumsum(counts) - counts
            left = total[owner] - (upto - weight - np.append(0.0, upto)[start][owner])
            many = counts[owner] - (np.arange(len(keys)) - start[owner])
            # A slot of one shingle holds no shared one.
            taken = np.flatnonzero(((left >= least * total[owner] - SLACK) | (many >= least * counts[owner] - SLACK)) & (seen > 1))
            whose = owner[taken]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[taken].view(np.int64)), batch.column("node").take(pa.array(whose)), batch.column("label").take(pa.array(whose)),
                    pa.array(left[taken]), pa.array(total[whose]), pa.array(many[taken].astype(np.int32)), pa.array(counts[whose].astype(np.int32)),
                ],
                names=["key", "node", "label", "left", "weight", "many", "shingles"],
            )

    listed = kept_table(open_texts.mapInArrow(first, "key long, node long, label long, left double, weight double, many int, shingles int"), "prefixes")
    side = lambda n: listed.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "label", "left", "weight", "many", "shingles")])
    enough = lambda held, whole: (
        F.least(f"{held}_1", f"{held}_2") >= least / (1 + least) * (F.col(f"{whole}_1") + F.col(f"{whole}_2")) - SLACK
    )
    return (
        side(1).join(side(2).hint("merge"), "key")
        .where((F.col("node_1") < F.col("node_2")) & (F.col("label_1") != F.col("label_2")) & (enough("left", "weight") | enough("many", "shingles")))
        .select(F.col("node_1").alias("a"), F.col("node_2").alias("b"))
        .distinct()
    )


def _relabelled(labels: DataFrame | None, near: DataFrame) -> DataFrame:
    """node, label after new links; only the links between labels are followed."""
    if labels is None:
        return components(near)
    if near.isEmpty():
        return labels
    ends = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    held = labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    of = lambda end: held.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    between = near.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a != b").distinct()
    merged = components(between).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return kept_table(held.join(merged, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def near_classes(
    docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows_per_band: int = ROWS, rare: float = RARE, small: int = SMALL, agree: int = AGREE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, rid, digest, node, class_id, class_texts, n_links.

    ``node`` is the id of the text, ``class_id`` the smallest doc_id of its
    class; ``class_texts`` counts the class's different texts and ``n_links``
    the pairs of this text that were compared and found near.
    """
    rows = _text_rows(docs)
    frequencies = frequent_words(rows, rare)
    signed = kept_table(signatures(rows, frequencies, bands, rows_per_band), "signatures")
    known = kept_table(signed.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("node")), "texts")
    named = kept_table(
        signed.drop("bands").join(known, "digest", "left").withColumn("node", F.coalesce("node", "rid")), "named"
    )
    # One row per text, the signature of the row that names it; and one per text and band.
    own = kept_table(
        signed.join(known, "digest").where("rid = node").select("node", "weight", "shingles", "bands").dropDuplicates(["node"]), "own"
    )
    members = own.select("node", F.posexplode("bands").alias("band", "key"))
    crowd = kept_table(members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    members = kept_table(members.join(crowd, ["band", "key"]), "members")
    # Texts that share fewer bands than a pair has to agree in have no pair.
    popular = kept_table(
        members.groupBy("node").agg(F.sum("n").alias("fame"), F.count("*").alias("shared")).where(F.col("shared") >= agree).drop("shared"), "fame"
    )
    # Candidates' texts, once, whatever the number of their pairs.
    texts = kept_table(
        rows.select(F.col("rid").alias("node"), "text").join(small_side(popular.select("node")), "node", "left_semi").dropDuplicates(["node"]),
        "candidates",
    )
    members = kept_table(
        members.join(popular, "node").join(own, "node").select(
            "node", "weight", "shingles", "fame", "bands", "band", F.xxhash64("band", "key").alias("bucket"), F.lit(False).alias("narrow"), F.col("node").alias("label")
        ),
        "buckets",
    )
    done = links = labels = None
    for turn in range(3):
        if turn < 2:
            pairs = _pairs(members, least, agree, PIVOTS if turn else 1)
        else:
            pairs = _exact_pairs(members.select("node", "label").distinct(), texts, frequencies, least)
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = small_side(kept_table(pairs, "pairs"))
        measured = kept_table(_compared(pairs, texts, frequencies), "compared")
        near = measured.where((F.col("similarity") >= least) | (F.col("plain") >= least)).select("a", "b")
        done = measured if done is None else done.union(measured)
        links = near if links is None else links.union(near)
        labels = _relabelled(labels, near)
        if turn == 2:
            break
        now = members.where(~F.col("narrow")).drop("label", "narrow").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        still_open = (
            now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
            .where("low < high").select("bucket", (F.col("size") <= small).alias("narrow"))
        )
        members = kept_table(now.join(still_open, "bucket"), "buckets")
        if members.isEmpty():
            break
    classes = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    figures = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    texts_of = classes.select("label", "node").distinct().groupBy("label").agg(F.count("*").alias("class_texts"))
    return (
        classes.join(kept_table(figures.join(texts_of, "label"), "classes"), "label")
        .join(ends, "node", "left")
        .select("doc_id", "rid", "digest", "node", "class_id", "class_texts", F.coalesce("n_links", F.lit(0)).alias("n_links"), "label")
    )


def distinct_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each class, the one of the smallest doc_id, all columns kept."""
    found = near_classes(docs, **settings)
    first = found.groupBy("label").agg(F.min("rid").alias("__least"), F.min(F.when(F.col("rid") >= 0, F.col("rid"))).alias("__first"))
    keep = first.select(F.coalesce("__first", "__least").alias("__rid"))
    keyed = docs.withColumn("__rid", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseOR(F.lit(-(1 << 63)))))
    kept = keyed.join(keep.distinct(), "__rid")
    has_words = F.coalesce(F.length(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", "")), F.lit(0)) > 0
    # Rows of one document are copies of each other when they have words; others all stay.
    return (
        kept.withColumn("__copy", F.when(has_words, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1))
        .dropDuplicates(["__rid", "__copy"])
        .select(*docs.columns)
    )


def op3_near_classes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_classes(docs).select("doc_id", "class_id", "class_texts", "n_links")
