"""Near-duplicate documents: MinHash signatures joined by multi-index Hamming search, confirmed on full sets.

A document's set is its distinct word shingles. Documents with one and the same set form a class, searched once.
A signature has CHUNKS * WIDTH symbols of 16 bits, the least values of as many hash functions. Two signatures that
differ in fewer than CHUNKS * (ERRORS + 1) symbols agree, by pigeonhole, in all but ERRORS symbols of some chunk;
so every chunk is indexed once for each choice of the symbols left out. With 16 chunks of 5 symbols and one error,
all pairs that differ in at most 31 of 80 symbols meet; a pair of similarity 0.8 differs in 16 on average, in over 31
with a probability near 0.00001, and even then it mostly meets.

Buckets are searched by leaders, never pairwise. A bucket's first leader is the member that meets most others; each
member is compared with it. Members of one component need no more comparing. Members of buckets that don't form one
component yet may still be similar: these meet again under their rare shingles. A set of n shingles that shares 80 % of
the union with another must share one of its n - ceil(0.8 n) + 1 rarest, in any common order; so only these become
keys, and a set with as many shingles of its own alone has no partner at all. Those buckets are searched in rounds:
leaders are paired with the bucket's other components, then leave it, and the next are taken from outside its largest
component, more each round, until all buckets are done. The first shingle in that order that two sets
share bounds what they share by what follows it in either; only pairs that may still be similar are kept, and a pair
that is similar is kept at its first common shingle at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bloom import flagged, without_ids
from ledgerloom.llm.components import components, merged
from ledgerloom.llm.store import scratch, written
from ledgerloom.llm.words import SPACED, Words, buffer, filled, mixed, shingles, slices

CHUNKS, WIDTH, ERRORS = 16, 5, 1
_U = np.uint64
_FACTORS = mixed(np.arange(1, CHUNKS * WIDTH + 1, dtype=_U)) | _U(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Ascending hashes of each text's distinct shingles, for runs of rows from the given one."""
    for a, b in slices(texts):
        words = Words(*buffer(texts.slice(a, b - a)), SPACED)
        hashes, first = shingles(words.hashes(), words.first, size)
        out = []
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = np.sort(hashes[i:j])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
        yield a, out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Symbols of each set, none of them empty: the least of its hashes under each function, cut to 16 bits."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), len(_FACTORS)), np.uint16)
    for i, factor in enumerate(_FACTORS):
        out[:, i] = (mixed(np.minimum.reduceat(flat * factor, at)) & _U(0xFFFF)).astype(np.uint16)
    return out


def _set_hash(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _sketch(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_sets(filled(batch.column(1)), size):
                full = [s for s in sets if len(s)]
                own = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_set_hash(s) for s in sets], pa.binary()),
                        pa.array([next(own).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["id", "n_shingles", "set_hash", "signature"],
                )

    return sketch


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of each signature: for each chunk, and each choice of ERRORS symbols left out, a hash of the others."""
    left = list(combinations(range(WIDTH), WIDTH - ERRORS))
    out = np.empty((len(symbols), CHUNKS * len(left)), _U)
    for chunk in range(CHUNKS):
        part = symbols[:, chunk * WIDTH : (chunk + 1) * WIDTH].astype(_U)
        for i, kept in enumerate(left):
            key = np.full(len(symbols), chunk * len(left) + i + 1, _U)
            for at in kept:
                key = mixed(key * _U(0x9E3779B97F4A7C15) + part[:, at])
            out[:, chunk * len(left) + i] = key
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, -1)
            keys = chunk_keys(symbols)
            ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in shingle_sets(filled(batch.column(0)), size):
                values = pa.array(np.concatenate(found).view(np.int64)) if found else pa.array([], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([_set_hash(s) for s in found], pa.binary()), lists], names=["set_hash", "set"])

    return sets


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sides = [], []
            for column in (batch.column(2), batch.column(3)):
                flat = column.flatten().to_numpy(zero_copy_only=False).view(_U)
                sides.append((flat, np.cumsum([0, *column.value_lengths().to_pylist()])))
            (flat_a, at_a), (flat_b, at_b) = sides
            for i in range(batch.num_rows):
                a, b = flat_a[at_a[i] : at_a[i + 1]], flat_b[at_b[i] : at_b[i + 1]]
                both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _full_sets(docs: DataFrame, classes: DataFrame, met: DataFrame, size: int) -> DataFrame:
    """id, n and set of the classes met: the texts of one document of each are read into sets."""
    wanted = written(classes.join(met, "id").select("id", "set_hash", "doc"), "wanted")
    texts = flagged(docs, wanted.select(F.col("doc").alias("id")), F.col("id"), wanted.count(), "seen", least=1).where("seen").select("text")
    sets = texts.mapInArrow(_sets(size), "set_hash binary, set array<long>").join(wanted, "set_hash").dropDuplicates(["id"])
    return written(sets.select("id", F.size("set").alias("n"), "set"), "sets")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of ids, those whose full sets are similar enough. Sets of too different sizes aren't compared."""
    sizes = sets.select("id", "n")
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}")), side)
    near = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")
    for side in ("a", "b"):
        near = near.join(sets.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}")), side)
    return near.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long")


def _live(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, id, label (the component) of the members of buckets that hold more than one component."""
    now = written(members.join(roots.withColumnRenamed("node", "id"), "id", "left").select(*members.columns, F.coalesce("root", "id").alias("label")), "labelled")
    live = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return written(now.join(written(live, "live-keys"), "key", "left_semi"), "live")  # a join of two plain exchanges: Spark splits hot keys


def _rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """key, id, n, place: the rarest shingles of each set with their places, as many as a similar set must share one of, but for those that no other has."""
    each = sets.select("id", "n", F.explode("set").alias("key"))
    often = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "often")
    shared = each.join(often, "key")
    own = Window.partitionBy("id")
    ranked = shared.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own)).withColumn("at", F.row_number().over(own.orderBy("sets", "key")))
    ranked = ranked.withColumn("place", F.col("at") + F.col("alone"))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("key", "id", "n", "place")


def _may_be_similar(percent: int) -> Column:
    """Whether sets of n and lead_n shingles whose first common one has these places can reach the similarity."""
    most = F.least(F.col("n") - F.col("place"), F.col("lead_n") - F.col("lead_place")) + 1
    return most * 100 >= (F.col("n") + F.col("lead_n") - most) * percent


def _roots(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """node, root: the component of each class that any chain of similar pairs connects to another."""
    keys = classes.select("id", "signature").mapInArrow(_keys, "key long, id long")
    counts = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")  # a join of two plain exchanges: Spark splits hot keys
    members = written(keys.join(counts, "key"), "members")
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    known = written(members.select("key", "id").join(met, "id"), "known")
    leads = written(known.groupBy("key").agg(F.max(F.struct("met", F.negative("id").alias("id"))).alias("best")).select("key", F.negative("best.id").alias("lead")), "leads")
    members = written(known.select("key", "id").join(leads, "key").where("id <> lead"), "buckets")
    pairs = written(members.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct(), "pairs")
    met = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "met")
    sets = _full_sets(docs, classes, met, size)
    roots = components(written(_links(pairs, sets, percent), "links"))
    open_ids = written(_live(members.select("key", "id"), roots).select("id").distinct(), "open")
    members = written(_rare_keys(sets.join(open_ids, "id", "left_semi"), percent), "buckets")
    tested, leaders = pairs, 8
    while True:
        now = _live(members, roots)
        if now.isEmpty():
            return roots
        largest = now.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        outside = now.join(written(largest, "largest"), "key").where("label <> main").drop("main")
        ranked = outside.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("at") <= leaders)
        chosen = written(ranked.select("key", *[F.col(c).alias(f"lead_{c}") for c in ("id", "label", "n", "place")]), "leaders")
        pairs = now.join(chosen, "key").where(F.col("label") != F.col("lead_label")).where(_may_be_similar(percent)).select(F.least("id", "lead_id").alias("a"), F.greatest("id", "lead_id").alias("b"))
        pairs = written(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        members = written(now.join(chosen.select("key", F.col("lead_id").alias("id")), ["key", "id"], "left_anti").drop("label"), "buckets")
        roots = merged(roots, written(_links(pairs, sets, percent), "links"))
        tested, leaders = tested.unionByName(pairs), leaders * 16


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    Words stand between white space, A-Z lower-cased. The set is that of `size`-word shingles; a text of fewer words
    has its whole sequence as its only shingle; one without words, or null, has none and is linked with nothing.
    Documents whose sets share at least `percent` hundredths of their union are linked. component_id is the smallest
    id reachable, that of rows with an id; kept is whether it is the document's own. Rows repeated with one id are each
    reported, each linked by its own text. Rows with a null id are linked with those of the
    same set only. Extra columns are ignored; an
    empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        sketch = written(own.mapInArrow(_sketch(size), "id long, n_shingles long, set_hash binary, signature binary"), "sketch")
        # a class is numbered by its row: ids may repeat
        classes = sketch.where("n_shingles > 0").groupBy("set_hash").agg(F.min("id").alias("doc"), F.first("signature").alias("signature"))
        classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        roots = _roots(classes, own, size, percent)
        named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("set_hash", "doc", F.coalesce("root", "id").alias("root"))
        least = written(named.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
        named = written(named.join(least, "root").select("set_hash", "component_id"), "named")
        several = sketch.where("n_shingles > 0").join(named, "set_hash")
        alone = sketch.where("n_shingles = 0").withColumn("component_id", F.col("id"))
        out = several.select("id", "n_shingles", "component_id").unionByName(alone.select("id", "n_shingles", "component_id"))
        return keep(out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "near")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one document of each component of near_duplicates: the one with the smallest id. Columns are those of docs.

    Empty texts and rows with a null id stay. Rows that share an id stay or go together: they stay where one is kept.
    """
    with scratch(docs.sparkSession) as keep:
        near = near_duplicates(docs, size, percent, text_col, id_col)
        dropped = keep(near.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.bool_or("kept").alias("stays")).where("not stays").select(id_col), "dropped")
    return without_ids(docs, dropped, id_col, dropped.count())
