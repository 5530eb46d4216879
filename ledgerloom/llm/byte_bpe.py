"""Byte-level BPE with built-in functions only.

Texts are cut by the pre-token pattern. A word's pieces are an array of places, folded by a higher-order function:
every step merges the leftmost pair of the least rank, until no pair has a rank. Ranks are one literal: an array of
small maps, a piece's map given by its CRC, so that a look-up takes a few comparisons. The commonest distinct words of
the corpus, at most `dictionary` of them, are folded once and become a second such literal; all other words are folded
where they stand. Decoding joins the literal pieces of the ids, a character for each byte, and encodes them.

A long word is folded in blocks, so that time grows with its length. Pieces are a word's encoding exactly if every two
that follow each other are the encoding of what they spell together. So blocks are put together where that holds at the
seam; else some pieces on both sides are folded anew, and if a seam still fails, the whole of both.
"""

from __future__ import annotations

import base64
import json
import zlib

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import scratch, written

#: Bytes of a block of a long word, and pieces that are folded anew on each side of a seam where two don't fit.
BLOCK, SEAM = 256, 8
#: The charset that has a character for each byte.
BYTES = "ISO-8859-1"
#: Stands for the rank of a merge that there is not.
NONE = 1 << 30
DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def java_pattern(pattern: str) -> str:
    """The pattern with the white space of Unicode spelt out, for which \\s stands in other dialects."""
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _literal(value: object, schema: str) -> Column:
    """A value as a literal: the optimiser folds from_json of a constant."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), schema)


def _bucketed(entries: dict[str, object], kind: str) -> tuple[Column, int]:
    """A literal of small maps, the one of a key given by its CRC, and how many they are."""
    count = max(1, len(entries) // 3)
    buckets: list[dict] = [{} for _ in range(count)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % count][key] = value
    return _literal(buckets, f"array<map<string,{kind}>>"), count


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _looked_up(table: tuple[Column, int], key: Column) -> Column:
    return F.get(table[0], (F.crc32(key) % table[1]).cast("int"))[key]


def merged(word: Column, ranks: tuple[Column, int]) -> Column:
    """The pieces of a word, a character for each byte, after all merges.

    The word is never taken apart before the end: a long stands for each place where a piece begins, and for the word's
    end. It has the rank of the merge that would do away with the place, NONE if there is none, and below it the place:
    so the least long is the leftmost place of the least rank. A merge drops it and looks up the two places beside it.
    """

    def merging(w: Column) -> Column:
        def coded(begin: Column, at: Column, end: Column) -> Column:
            rank = _looked_up(ranks, F.substring(w, begin + 1, end - begin))
            return F.shiftleft(F.coalesce(rank, F.lit(NONE)).cast("long"), 32) + at

        def step(now: Column, _: Column) -> Column:
            def merge(i: Column) -> Column:
                a, b, c, d = (_place(F.get(now, i + k)) for k in (-3, -2, 0, 1))
                left = F.when(a.isNull(), F.get(now, i - 2)).otherwise(coded(a, b, c))
                right = F.when(d.isNull(), F.get(now, i)).otherwise(coded(b, c, d))
                return F.flatten(F.array(F.slice(now, F.lit(1), i - 2), F.array(left, right), F.slice(now, i + 2, F.size(now))))

            return _let(F.array_min(now), lambda low: F.when(low >= NONE << 32, now).otherwise(_let(F.array_position(now, low).cast("int"), merge)))

        def cut(places: Column) -> Column:
            return F.transform(F.slice(places, F.lit(2), F.size(places) - 1), lambda end, i: F.substring(w, F.get(places, i) + 1, end - F.get(places, i)))

        size = F.length(w)
        each = F.transform(F.sequence(F.lit(0), size), lambda i: F.when((i == 0) | (i == size), F.lit(NONE << 32) + i).otherwise(coded(i - 1, i, i + 1)))
        left = F.aggregate(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), each, step)
        return F.when(size == 0, F.array().cast("array<string>")).otherwise(_let(F.transform(left, _place), cut))

    return _let(word, merging)


def _place(coded: Column) -> Column:
    return coded.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def spelt(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def merged_in_blocks(word: Column, ranks: tuple[Column, int], block: int = BLOCK, seam: int = SEAM) -> Column:
    """The same of a long word, from its blocks."""

    def fits(a: Column, b: Column) -> Column:
        return merged(F.concat(a, b), ranks) == F.array(a, b)

    def put_together(left: Column, right: Column) -> Column:
        def mended(middle: Column) -> Column:
            before, after = F.slice(left, F.lit(1), F.greatest(F.size(left) - seam, F.lit(0))), F.slice(right, F.lit(seam + 1), F.size(right))
            good = (F.size(before) == 0) | fits(F.element_at(before, -1), F.element_at(middle, 1))
            good &= (F.size(after) == 0) | fits(F.element_at(middle, -1), F.element_at(after, 1))
            return F.when(good, F.concat(before, middle, after)).otherwise(merged(spelt(F.concat(left, right)), ranks))

        beside = F.concat(F.slice(left, -F.least(F.size(left), F.lit(seam)), F.lit(seam)), F.slice(right, F.lit(1), F.lit(seam)))
        whole = F.when(fits(F.element_at(left, -1), F.element_at(right, 1)), F.concat(left, right)).otherwise(_let(merged(spelt(beside), ranks), mended))
        return F.when(F.size(left) == 0, right).otherwise(whole)

    starts = F.sequence(F.lit(1), F.length(word), F.lit(block))
    blocks = F.transform(starts, lambda at: merged(F.substring(word, at, F.lit(block)), ranks))
    return F.aggregate(blocks, F.array().cast("array<string>"), put_together)


def word_ids(word: Column, ranks: tuple[Column, int]) -> Column:
    """A word's ids as decimal text, joined by spaces."""

    def ids(w: Column) -> Column:
        pieces = F.when(F.length(w) <= BLOCK, merged(w, ranks)).otherwise(merged_in_blocks(w, ranks))
        each = F.transform(pieces, lambda p: _looked_up(ranks, p).cast("string"))
        return F.coalesce(_looked_up(ranks, w).cast("string"), F.array_join(each, " "))

    return _let(F.decode(word.cast("binary"), BYTES), ids)


def common_words(words: DataFrame, most: int) -> DataFrame:
    """Those of the distinct words, at most `most`, that occur oftenest: all that occur at least as often as some number says."""
    counts = written(words.groupBy("word").count(), "counts")
    least, total = None, 0
    for row in counts.groupBy("count").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("count")).limit(most).toLocalIterator():
        total += row["words"]
        if total > most:
            break
        least = row["count"]
    return counts.where(F.lit(False) if least is None else F.col("count") >= least).select("word")


def encode_and_decode(docs: DataFrame, path: str = DEFAULT_RANKS, pattern: str = public_tokenizers.PATTERN, dictionary: int = 200_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the bytes that the ids decode to. Null
    texts count as empty, with no ids. Repeated rows, and rows with a null id, are each reported; texts and words may
    be of any length; extra columns are ignored; an empty table gives no rows. Only distinct words shuffle, to be counted
    over all documents; the literal of the commonest is bounded by `dictionary`.
    """
    known = read_ranks(path)
    rank_maps, count = _bucketed({piece.decode(BYTES): rank for piece, rank in known.items()}, "int")
    pieces: list[str] = [""] * (max(known.values()) + 1)
    for piece, rank in known.items():
        pieces[rank] = piece.decode(BYTES)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    with scratch(docs.sparkSession):
        common = common_words(docs.select(F.explode(words).alias("word")), dictionary)
        folded = _let(rank_maps, lambda r: word_ids(F.col("word"), (r, count)))
        found = common.repartition(F.xxhash64("word")).select("word", folded.alias("ids")).toArrow()
    word_maps, word_count = _bucketed(dict(zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True)), "string")
    # the literal of ranks is bound once: the plan has one copy of it
    of = lambda r: F.transform(words, lambda w: F.coalesce(_looked_up((word_maps, word_count), w), word_ids(w, (r, count))))
    ids = docs.select(F.col(id_col), F.array_join(_let(rank_maps, of), " ").alias("ids"))
    vocabulary = _literal(pieces, "array<string>")
    each = F.when(F.col("ids") == "", F.array().cast("array<string>")).otherwise(F.split("ids", " "))
    spelling = F.array_join(F.transform("each", lambda i: F.get(vocabulary, i.cast("int"))), "")
    return ids.withColumn("each", each).select(
        F.col(id_col),
        F.size("each").cast("long").alias("n_tokens"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode(spelling, BYTES), 256).alias("decoded_sha256"),
    )
