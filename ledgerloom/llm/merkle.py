"""A Merkle manifest of a dataset: each row's digest, and its path of siblings up to one root.

Rows are the leaves of a tree for each value of a column, and the trees' roots are the leaves of one more. A tree's
nodes are cut into aligned blocks of fan ** height, each walked by one task in post-order: a subtree gives its digest,
and while the recursion unwinds, the leaves below each child get the digests of its siblings. The blocks' roots are the
nodes of the next, much smaller table, which is walked in the same way, until each tree has one node. The paths then come
down the same tables: a block is given the path of its root, and each of its nodes has its own siblings before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.numbering import numbered
from ledgerloom.llm.store import scratch, written

Path = list[tuple[bytes, bytes]]


def digest_of(values: list[Column]) -> Column:
    """SHA-256, in hex, of `-` for a null and `length in bytes:value` else, one after the other."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def unwound(digests: list[bytes], paths: list[Path], low: int, height: int, fan: int) -> bytes:
    """The digest of the subtree of fan ** height leaves from low on. Each leaf below gets its siblings, level by level, left and right ones apart."""
    if not height:
        return digests[low]
    step = fan ** (height - 1)
    starts = range(low, min(low + fan * step, len(digests)), step)
    found = [unwound(digests, paths, s, height - 1, fan) for s in starts]
    for k, s in enumerate(starts):
        beside = (b"".join(found[:k]), b"".join(found[k + 1 :]))
        for leaf in range(s, min(s + step, len(digests))):
            paths[leaf].append(beside)
    return hashlib.sha256(b"".join(found).hex().encode()).digest()


def block_height(total: int, fan: int, most: int) -> int:
    """Levels of a block of a tree that has total nodes here: as many as leave one node, but at most `most`."""
    height = 0
    while total > 1 and height < most:
        total, height = -(-total // fan), height + 1
    return height


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Rows that agree in the first `keys` columns, which stand together, a list at a time."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(list(row.values())[:keys])
            if rows and key != now:
                yield rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield rows


_UP = "tree string, at long, total long, digest binary"
_UP_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.binary())


def _up(fan: int, height: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 2):
            total = rows[0]["total"]
            root = unwound([r["digest"] for r in rows], [[] for _ in rows], 0, block_height(total, fan, height), fan)
            values = (rows[0]["tree"], rows[0]["block"], -(-total // fan**height), root)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _UP_KINDS, strict=True)], names=["tree", "at", "total", "digest"])

    return walk


_SIDES = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
_DOWN = "tree string, at long, id long, digest binary, carried binary, path array<struct<left: binary, right: binary>>, subroot binary, root binary"
_DOWN_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), _SIDES, pa.binary(), pa.binary())


def _down(fan: int, height: int):
    """The first row of a block is its root with the path from there; the others are its nodes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, *rows in _blocks(batches, 2):
            paths: list[Path] = [[] for _ in rows]
            unwound([r["digest"] for r in rows], paths, 0, block_height(rows[0]["total"], fan, height), fan)
            rest = [(p["left"], p["right"]) for p in root["path"]]
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                every = [p for path in paths[at : at + 512] for p in path + rest]
                ends = [0]
                for path in paths[at : at + 512]:
                    ends.append(ends[-1] + len(path) + len(rest))
                sides = pa.StructArray.from_arrays([pa.array([p[i] for p in every], pa.binary()) for i in (0, 1)], ["left", "right"])
                columns = [[r[c] for r in part] for c in ("tree", "at", "id", "digest", "carried")]
                columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sides), [root["subroot"]] * len(part), [root["root"]] * len(part)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _DOWN_KINDS, strict=True)], names=["tree", "at", "id", "digest", "carried", "path", "subroot", "root"])

    return walk


def _raised(nodes: DataFrame, fan: int, height: int) -> list[DataFrame]:
    """nodes (tree, at, total, digest and more), the roots of their blocks, and so on up to one node a tree."""
    tables = [nodes]
    while (tables[-1].agg(F.max("total")).first()[0] or 0) > 1:
        laid = tables[-1].select("tree", F.expr(f"at div {fan**height}").alias("block"), "at", "total", "digest")
        tables.append(written(laid.repartition("tree", "block").sortWithinPartitions("tree", "block", "at").mapInArrow(_up(fan, height), _UP), "roots"))
    return tables


def _lowered(nodes: DataFrame, parents: DataFrame, fan: int, height: int) -> DataFrame:
    """nodes with their paths, of parents' (tree, at, path, subroot, root). A block's parent goes before its nodes, so nothing is joined."""
    kinds = dict(nodes.dtypes)
    more = lambda c, kind: F.col(c) if c in kinds else F.lit(None).cast(kind)
    down = [F.lit(None).cast(k).alias(c) for c, k in (("path", "array<struct<left: binary, right: binary>>"), ("subroot", "binary"), ("root", "binary"))]
    own = nodes.select("tree", F.expr(f"at div {fan**height}").alias("block"), "at", "total", "digest", more("id", "long").alias("id"), more("carried", "binary").alias("carried"), *down)
    above = parents.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), *[F.lit(None).cast(k).alias(c) for c, k in (("total", "long"), ("digest", "binary"), ("id", "long"), ("carried", "binary"))], "path", "subroot", "root")
    laid = own.unionByName(above).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return laid.mapInArrow(_down(fan, height), _DOWN)


def _with_paths(tables: list[DataFrame], parents: DataFrame, fan: int, height: int) -> DataFrame:
    """The first table's nodes with their paths, of the last one's."""
    for k, nodes in enumerate(reversed(tables)):
        parents = _lowered(nodes, parents, fan, height)
        if k < len(tables) - 1:
            parents = written(parents, "paths")
    return parents


def manifest(docs: DataFrame, fields: list[str], tree_col: str, id_col: str, changed: Column | None = None, fan: int = 8, height: int = 4) -> DataFrame:
    """One row per row of docs: tree, id, leaf, carried, path (left and right siblings of each level, from the leaf up), subroot, root.

    All digests are binary. A leaf is the digest of the fields. Trees are the values of tree_col; a tree's leaves stand by
    id, null first, and rows that share an id by their digests, so rows that are equal throughout are leaves next to each
    other. Every fan nodes in a row, the last run maybe fewer, become the digest of their digests in hex, while there is
    more than one; then the trees' roots, null first and by UTF-8 bytes, do likewise. changed is a hex digest of each row
    that goes along as `carried`. A task holds fan ** height nodes at once. Texts of any length are digested where they are
    read, and shuffle as 32 bytes. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    carried = F.unhex(changed) if changed is not None else F.lit(None).cast("binary")
    with scratch(spark) as keep:
        leaves = written(docs.select(F.col(tree_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("id"), F.unhex(digest_of([F.col(c) for c in fields])).alias("digest"), carried.alias("carried")), "leaves")
        placed = numbered(leaves, [F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest"), F.col("carried")], "place")
        trees = written(placed.groupBy("tree").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("total")), "trees")
        starts = trees.withColumnRenamed("tree", "of")
        nodes = placed.join(starts, F.col("tree").eqNullSafe(F.col("of"))).select("tree", (F.col("place") - F.col("first")).alias("at"), "total", "digest", "id", "carried")
        own = _raised(written(nodes, "nodes"), fan, height)
        roots = numbered(own[-1].select(F.col("tree").alias("of"), "digest"), [F.col("of").asc_nulls_first()], "at")
        n = roots.count()
        every = _raised(roots.select(F.lit("").alias("tree"), "at", F.lit(n).cast("long").alias("total"), "digest"), fan, height)
        top = every[-1].select("tree", "at", F.array().cast("array<struct<left: binary, right: binary>>").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
        found = written(_with_paths(every, top, fan, height).select("at", "path", F.col("digest").alias("subroot"), "root"), "subroots")
        parents = roots.select("of", "at").join(found, "at").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), "path", "subroot", "root")
        return keep(_with_paths(own, parents, fan, height).select("tree", "id", F.col("digest").alias("leaf"), "carried", "path", "subroot", "root"), "manifest")


def siblings_digest(path: Column) -> Column:
    """The digest, in hex, of all of a path's digests in hex, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.lower(F.concat(F.hex(p["left"]), F.hex(p["right"])))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root, in hex, that a leaf (in hex) has by its path."""
    return F.aggregate(path, leaf, lambda now, p: F.sha2(F.concat(F.lower(F.hex(p["left"])), now, F.lower(F.hex(p["right"]))), 256))


def tamper_report(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and what its paths tell of documents of which a third have A-Z of their texts lower-cased.

    Tampered are rows where 3 divides the CRC-32 of the decimal doc_id; a null id or text stays as it is.
    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = F.when(touched, digest_of([*map(F.col, fields[:-1]), lower])).otherwise(digest_of([F.col(c) for c in fields]))
    hexed = lambda c: F.lower(F.hex(c))
    rows = manifest(docs, fields, "lang", "doc_id", changed=now)
    out = rows.select(F.col("id").alias("doc_id"), hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"), folded(hexed("carried"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
