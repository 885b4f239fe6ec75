"""Operator 5: fuzzy line deduplication by MinHash.

Lines that hold anything but white space are compared over the whole corpus.
Equal lines are one line by their hash, whatever their length.  Different lines
are similar if their lengths, and their sets of SHINGLE-character shingles by
Jaccard, agree to SIMILARITY.  MinHash signatures of the shingles put similar
lines into common cells; in a cell the exact similarity decides, and a
distributed union-find joins the links.  Of each component the line that comes
first (by doc_id, then place; of rows that share both, the smaller hash) stays.

Lines of up to SHORT shingles have a signature of independent permutations,
lines of SIMILARITY * SHORT or more a one-permutation signature; a similar pair
shares at least one kind.  A pair of similarity 0.8 shares a cell with
probability 1 - (1 - 0.8**ROWS)**BANDS, 99.5 %; one of 0.85 with 99.9 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, materialize
from ledgerline.llm.components import connected_components, joined_within, spanning_links

SIMILARITY = 0.8
SHINGLE = 6
#: Shingles up to which a line has an independent permutation for each place of its signature.
SHORT = 100
BANDS, ROWS = 10, 4
BUCKETS = BANDS * ROWS
#: Code points that are hashed at once; what a processor's cache holds.
SLICE = 1 << 15
#: Lines of a cell that one task compares; larger cells are compared in blocks by several.
CELL_ROWS = 2000
#: Up to so many candidate lines are looked up by a broadcast; more by a shuffle.
BROADCAST_ROWS = 1_000_000
_BLANK = " \t\n\v\f\r"
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_EMPTY = np.uint64((1 << 64) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _pieces(lines: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Line numbers and texts of SLICE characters in all; a longer line comes in pieces that share SHINGLE - 1."""
    number, text, size = [], [], 0
    for i, line in enumerate(lines):
        for at in range(0, max(1, len(line) - SHINGLE + 1), SLICE):
            piece = line[at : at + SLICE + SHINGLE - 1]
            if text and size + len(piece) > SLICE:
                yield number, text
                number, text, size = [], [], 0
            number.append(i)
            text.append(piece)
            size += len(piece)
    if text:
        yield number, text


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each shingle."""
    sizes = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h, n = codes, 1
    for bit in bin(SHINGLE)[3:]:  # hashes of n characters become those of 2 * n, or one more
        h = h[:-n] * np.uint64(int(_MULTIPLY) ** n & (1 << 64) - 1) + h[n:]
        n *= 2
        if bit == "1":
            h = h[:-1] * _MULTIPLY + codes[n:]
            n += 1
    inside, ends = np.ones(len(codes), bool), np.cumsum(sizes)
    for back in range(1, SHINGLE):  # the last characters of a line begin no shingle
        inside[ends - back] = False
    inside = inside[: len(h)]
    return np.repeat(np.arange(len(lines)), sizes)[: len(h)][inside], _mix(h[inside])


def _keys(low: np.ndarray, kind: int) -> np.ndarray:
    """A key for each band of signatures."""
    keys = np.full((len(low), BANDS), 1, np.uint64) * np.arange(kind * BANDS + 1, (kind + 1) * BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix((keys ^ low[:, r::ROWS]) * _MULTIPLY)
    return keys


def _filled(low: np.ndarray) -> np.ndarray:
    """An empty bucket takes the next full one's, told apart by how far it is."""
    empty = low == _EMPTY
    for _ in range(1, BUCKETS):
        if not empty.any():
            break
        other = np.roll(low, -1, axis=1)
        fill = empty & (other != _EMPTY)
        low = np.where(fill, other + np.uint64(0x632BE59BD9B4E019), low)
        empty = low == _EMPTY
    return low


#: Odd, so that each permutes the hashes.
_SEEDS = _mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * _MULTIPLY) | np.uint64(1)


def _short_keys(lines: list[str]) -> np.ndarray:
    """Signatures of lines of at most SHORT shingles each."""
    line, h = _hashed(lines)
    start = np.searchsorted(line, np.arange(len(lines)))
    low = np.stack([np.minimum.reduceat(h * seed, start) for seed in _SEEDS], 1)
    return _keys(low, 0)


def _long_keys(lines: list[str]) -> np.ndarray:
    low = np.full(len(lines) * BUCKETS, _EMPTY, np.uint64)
    for number, pieces in _pieces(lines):
        line, h = _hashed(pieces)
        bucket = ((h >> np.uint64(40)) * np.uint64(BUCKETS) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(low, np.array(number)[line] * BUCKETS + bucket, h << np.uint64(24))
    return _keys(_filled(low.reshape(len(lines), BUCKETS)), 1)


def bands(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, key) of every band of the lines, which must have at least SHINGLE characters."""
    size = np.array([len(x) - SHINGLE + 1 for x in lines])
    number, keys = [], []
    for chosen, of in ((size <= SHORT, _short_keys), (size >= SIMILARITY * SHORT, _long_keys)):
        which = np.flatnonzero(chosen)
        if len(which):
            number.append(np.repeat(which, BANDS))
            keys.append(of([lines[i] for i in which]).ravel())
    return np.concatenate(number), np.concatenate(keys)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines: dict[str, None] = {}
        for text in batch["text"].to_pylist():
            lines.update(dict.fromkeys(x for x in text.split("\n") if len(x) >= SHINGLE and x.strip(_BLANK)))
        own = list(lines)
        for at in range(0, len(own), 5_000):
            part = own[at : at + 5_000]
            ids = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in part], np.uint64)
            number, keys = bands(part)
            yield pa.record_batch({"band": pa.array(keys.view(np.int64)), "id": pa.array(ids[number].view(np.int64))})


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands that hold several lines: (cell, id, n).  Cells of the same lines get the same number."""
    rest = None
    for batch in batches:
        rows = [batch["band"].to_numpy(), batch["id"].to_numpy()]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        rows = _once(*rows)
        if len(rows[0]) < 200_000:
            rest = rows
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        rest = [x[cut:] for x in rows]
        if cut:
            yield _shared(*(x[:cut] for x in rows))
    if rest is not None and len(rest[0]):
        yield _shared(*rest)


def _once(band: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    new = np.append(True, (np.diff(band) != 0) | (np.diff(ids) != 0))[: len(band)]  # rows come sorted; batches repeat lines
    return [band[new], ids[new]]


def _shared(band: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    start = np.flatnonzero(np.append(True, np.diff(band) != 0))
    n = np.diff(np.append(start, len(band)))
    name = _mix(np.add.reduceat(_mix(ids.view(np.uint64) * _MULTIPLY), start)).view(np.int64)
    several = np.repeat(n > 1, n)
    return pa.record_batch({"cell": pa.array(np.repeat(name, n)[several]), "id": pa.array(ids[several]), "n": pa.array(np.repeat(n, n)[several], pa.int64())})


def shingles(lines: list[str]) -> list[np.ndarray]:
    """The shingles of each line as distinct, sorted numbers; equal numbers are equal shingles, without exception."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.max(initial=0) >> _CODE_BITS:
        known, codes = np.unique(codes, return_inverse=True)
        few = not len(known) >> _CODE_BITS
    else:
        few = True
    codes = codes.astype(np.uint64)
    words = codes
    for k in range(1, SHINGLE if few else SHINGLE // 2):
        words = words[:-1] << np.uint64(_CODE_BITS if few else _HALF_BITS) | codes[k:]
    if not few:  # halves fit a number, and two numbers of halves another
        halves = np.unique(words, return_inverse=True)[1].astype(np.uint64)
        words = halves[: -(SHINGLE // 2)] << np.uint64(32) | halves[SHINGLE // 2 :]
    out, at = [], 0
    for line in lines:
        own = np.sort(words[at : at + len(line) - SHINGLE + 1])
        out.append(own[np.append(True, own[1:] != own[:-1])])
        at += len(line)
    return out


#: Bits of a character in the number of a shingle, and of half of one; the latter hold every code point.
_CODE_BITS = 64 // SHINGLE
_HALF_BITS = 64 // (SHINGLE // 2)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _verify(similarity: float):
    def like(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> bool:
        """Of (number of shingles, distinct shingles)."""
        if min(a[0], b[0]) < similarity * max(a[0], b[0]) or min(len(a[1]), len(b[1])) < similarity * max(len(a[1]), len(b[1])):
            return False
        common = _common(a[1], b[1])
        return common >= similarity * (len(a[1]) + len(b[1]) - common)

    def links(ids: list[int], known: dict[int, tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        if len(ids) == 2:
            return [tuple(ids)] if like(known[ids[0]], known[ids[1]]) else []
        sets = [known[i] for i in ids]
        length, sizes = np.array([n for n, _ in sets]), np.array([len(x) for _, x in sets])

        def near(i: int, others: np.ndarray) -> np.ndarray:
            out = np.zeros(len(others), bool)
            alike = (sizes[others] >= similarity * sizes[i]) & (sizes[i] >= similarity * sizes[others])
            for k in np.flatnonzero(alike & (length[others] >= similarity * length[i]) & (length[i] >= similarity * length[others])):
                out[k] = like(sets[i], sets[others[k]])
            return out

        return [(ids[a], ids[b]) for a, b in spanning_links(np.arange(len(ids)), near)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cells = rows["cell"].to_numpy()
            cut = int(np.flatnonzero(cells == cells[-1])[0]) if len(cells) else 0
            rest = rows.slice(cut)
            yield send(rows.slice(0, cut), cells[:cut])
        if rest is not None:
            yield send(rest, rest["cell"].to_numpy())

    def send(rows: pa.Table, cells: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.append(True, np.diff(cells) != 0)).tolist() if len(cells) else []
        ids, lines = rows["id"].to_pylist(), rows["line"].to_pylist()
        own = dict(zip(ids, lines))  # a line may stand in several cells
        known: dict[int, tuple[int, np.ndarray]] = {}
        group, size = [], 0
        for i, line in own.items():
            group.append(i)
            size += len(line)
            if size >= SLICE:
                known |= zip(group, ((len(own[k]) - SHINGLE + 1, x) for k, x in zip(group, shingles([own[k] for k in group]))))
                group, size = [], 0
        if group:
            known |= zip(group, ((len(own[k]) - SHINGLE + 1, x) for k, x in zip(group, shingles([own[k] for k in group]))))
        found = [x for a, b in zip(start, [*start[1:], len(cells)]) for x in links(ids[a:b], known)]
        return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=("a", "b"))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that repeat both doc_id and text are one document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def _lines(docs: DataFrame) -> DataFrame:
    lines = _keyed(docs).select("doc_id", "key", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("id", F.xxhash64("line"))


def similar_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, root) of the lines that are similar to another, different line; id is the line's XXH64."""
    if similarity < SIMILARITY:
        raise ValueError(f"the bands are made for similarities of {SIMILARITY} or more")
    text = bounded(docs).select(F.coalesce("text", F.lit("")).alias("text"))
    banded = text.mapInArrow(_band_rows, "band long, id long")
    cells = banded.repartition("band").sortWithinPartitions("band", "id").mapInArrow(_cells, "cell long, id long, n long")
    cells = materialize(cells.distinct(), "cells")
    wanted = materialize(cells.select("id").distinct(), "candidates")
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = _lines(docs).select("id", "line").join(chosen, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    small, large = F.col("n") <= CELL_ROWS, F.col("n") > CELL_ROWS

    def compared(rows: DataFrame, *keys: str) -> DataFrame:
        """Links of the lines of each group, joined within it."""
        group = rows.select(F.xxhash64(*keys).alias("cell") if len(keys) > 1 else F.col(*keys), "id").join(texts, "id").select("cell", "id", "line")
        return group.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(joined_within(_verify(similarity)), "a long, b long")

    links = compared(cells.where(small), "cell")
    if not cells.where(large).isEmpty():
        links = links.union(_crowded(cells.where(large), compared))
    return connected_components(links, joined=True).toDF("id", "root")


def _crowded(cells: DataFrame, compared) -> DataFrame:
    """Links of cells that are too large for a task.

    Each cell is dealt into blocks.  Lines are compared within their block, and
    one line of each block's largest component with those of the other blocks.
    What is then not joined to the cell's largest component meets the lines of
    every block, so that no pair is left out but those joined already.
    """
    parts = F.ceil(F.col("n") / CELL_ROWS)
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("id"), parts)).withColumn("parts", parts)
    within = materialize(compared(dealt, "cell", "block"), "block-links")

    def rooted(links: DataFrame) -> DataFrame:
        return dealt.join(connected_components(links).toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))

    def largest(rows: DataFrame, *keys: str) -> DataFrame:
        size = rows.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("id"))
        return size.groupBy(*keys).agg(F.max(F.struct("size", "root", "id")).alias("most")).select(*keys, "most.root", "most.id")

    between = materialize(compared(largest(rooted(within), "cell", "block"), "cell"), "between-links")
    both = within.union(between)
    now = materialize(rooted(both), "crowded")
    known = largest(now, "cell").select("cell", F.col("root").alias("main"))
    blocks = F.when(F.col("root") == F.col("main"), F.array("block")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    again = now.join(known, "cell").select("cell", "id", F.explode(blocks).alias("block"))
    mixed = again.join(now.join(known, "cell").where("root <> main").select("cell").distinct(), "cell", "left_semi")
    return both.union(compared(mixed, "cell", "block"))


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, gone): for each document that loses lines, their numbers from 0."""
    roots = materialize(similar_lines(docs, similarity), "line-roots")
    placed = _lines(docs).select("doc_id", "key", "no", "id").join(roots, "id", "left").select(F.coalesce("root", "id").alias("root"), F.struct("doc_id", "key", "no").alias("at"))
    placed = materialize(placed, "lines")
    first = materialize(placed.groupBy("root").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-lines")
    gone = placed.join(first, "root").where("at <> first")
    return gone.groupBy("at.key").agg(F.collect_set("at.no").alias("gone"))


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for text, drop in zip(texts.to_pylist(), gone.to_pylist()):
        if drop:
            numbers = set(drop)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in numbers)
        out.append(text)
    return pa.array(out, pa.string())


def cut_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """dedup_lines() with a last column ``removed_``, which replaces one of that name: how many lines the row lost."""

    def cut(text: pa.Array, gone: pa.Array) -> pa.Array:
        return _without(text, gone)

    cut.__annotations__ = {"text": pa.Array, "gone": pa.Array, "return": pa.Array}
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("key"))
    joined = keyed.join(repeated_lines(docs, similarity), "key", "left")
    new = joined.select("row", F.arrow_udf(cut, "string")(F.col("row.text"), F.col("gone")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_"))
    own = {c: F.col("row").getField(c) for c in docs.columns if c != "removed_"} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return new.select(*(value.alias(c) for c, value in own.items()), "removed_")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the repeated lines cut out of text; n_chars, where there is one, is set anew.

    Lines of white space stay.  A document whose lines are all gone keeps an
    empty text, a null text stays null.  Rows that repeat doc_id and text keep
    and lose the same lines.  A null doc_id comes before all others.
    """
    return cut_lines(docs, similarity).drop("removed_")
