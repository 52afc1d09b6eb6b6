"""Near-duplicate documents by SimHash, compared in bit-sliced blocks.

Fingerprints that differ in at most ``radius`` bits are linked. The 64 bits are cut
into ``radius + 2`` blocks; two linked fingerprints agree in at least two blocks, so
every pair of blocks keys one bucket per fingerprint and no link is missed. Inside a
bucket the bits lie vertically: plane ``b`` holds bit ``b`` of all fingerprints, 64 to a
machine word. One exclusive-or per plane yields that bit's difference for 64 pairs at
once, saturating carry-save counters add the planes up, and a block of 64 pairs is left
as soon as every counter in it has passed the radius.

Equal fingerprints are compared once. A bucket larger than a tile is cut into chunks,
and chunk pairs become tiles of their own, so no task holds an unbounded bucket. A tile
returns a spanning forest of its links: at most one edge per member, however dense.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.grouping import spanning
from factloom.operators.components import connected_components
from factloom.session import checkpoint

SEED = 42
BITS = 64
#: Fingerprints of a bucket compared in one tile, and queries compared at once.
TILE, QUERIES = 2048, 256
#: Planes between two looks at which blocks are done; divides the number of bits.
CHECKED = 8
#: Shingles whose bits are counted at once, to bound memory on very long texts.
SHINGLES = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the hashes of all word shingles; 0 for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    ones, total = np.zeros(BITS, np.int64), max(len(words) - width + 1, 1)
    for start in range(0, total, SHINGLES):
        part = words[start:start + SHINGLES + width - 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(width)))] or [digest(b" ".join(part), SEED)]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, print): ``print`` is the fingerprint as a signed long."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = np.array([fingerprint(t, width) for t in frame["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text_hash": frame["text_hash"], "print": marks.view(np.int64)})

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return kept.mapInPandas(run, "doc_id long, text_hash long, print long")


def _vertical(bits: np.ndarray) -> np.ndarray:
    """n x 64 bits to 64 planes of ceil(n / 64) machine words."""
    padded = np.zeros((-(-len(bits) // 64) * 64, BITS), np.uint8)
    padded[:len(bits)] = bits
    return np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)


def _over(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius, by comparing the counters' bits from the top."""
    over, equal = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for i in reversed(range(len(counts))):
        if radius >> i & 1:
            equal &= counts[i]
        else:
            over |= equal & counts[i]
            equal &= ~counts[i]
    return over


def near_rows(prints: np.ndarray, radius: int, read: list[int] | None = None) -> Iterator[np.ndarray]:
    """For every fingerprint with a neighbour: all positions within the radius, its own included.

    A block is one query against the 64 fingerprints of a machine word. It is left as soon as all its counters have
    passed the radius; planes that split the tile evenly come first, as they tell most pairs apart. ``read`` takes
    the number of blocks that each plane was read for.
    """
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    order = np.argsort(np.abs(2 * bits.sum(axis=0, dtype=np.int64) - len(prints)), kind="stable")
    planes = _vertical(bits)
    n, words = len(prints), planes.shape[1]
    unused = ~np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    for start in range(0, n, QUERIES):
        own = (-bits[start:start + QUERIES].astype(np.int64)).view(np.uint64)
        at = np.arange(start, start + len(own))
        gone = np.repeat(unused[None, :], len(own), axis=0)
        gone[at - start, at // 64] |= np.uint64(1) << (at % 64).astype(np.uint64)  # no neighbour of itself
        gone = gone.ravel()
        query, word = np.divmod(np.arange(len(gone)), words)
        counts = [np.zeros(len(gone), np.uint64) for _ in range(radius.bit_length() or 1)]
        for step, b in enumerate(order):
            if read is not None:
                read.append(len(gone))
            carry = planes[b, word] ^ own[query, b]
            for i in range(len(counts)):
                counts[i], carry = counts[i] ^ carry, counts[i] & carry
            gone |= carry
            if step % CHECKED == CHECKED - 1:
                gone |= _over(counts, radius)
                live = np.flatnonzero(~gone)
                if len(live) < len(gone):
                    query, word, gone, counts = query[live], word[live], gone[live], [c[live] for c in counts]
                if not len(live):
                    break
        lanes = np.unpackbits((~gone).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        block, lane = np.nonzero(lanes)
        mine, near = query[block], word[block] * 64 + lane
        for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(mine)) + 1):
            if len(part):
                yield np.sort(np.append(near[part], start + mine[part[0]]))


def _tile_edges(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if parts:
                tile = pd.concat(parts).drop_duplicates("print")
                ids = tile["print"].to_numpy()
                member, root = spanning(len(ids), near_rows(ids.view(np.uint64), radius))
                yield pd.DataFrame({"a": ids[root], "b": ids[member]})

        held, size, rest = [], 0, None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame[["band", "bits", "part"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(frame) else np.array([0])
            rest = frame.iloc[starts[-1]:]  # the last bucket may go on in the next frame
            sizes = np.diff(starts)
            paired = np.repeat(sizes > 1, sizes)
            whole = frame.iloc[:starts[-1]][paired]
            sizes, at = sizes[sizes > 1], 0
            for n in sizes:
                if size + n > TILE and held:
                    yield from flush(held)
                    held, size = [], 0
                held.append(whole.iloc[at:at + n])
                size, at = size + n, at + n
        if rest is not None and len(rest) > 1:
            held.append(rest)
        yield from flush(held)

    return run


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``radius`` bits, up to connection."""
    blocks = radius + 2
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [F.shiftrightunsigned("print", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(blocks)]
    keys = []
    for band, (i, j) in enumerate(combinations(range(blocks), 2)):
        joined = F.shiftleft(block[i], cuts[j + 1] - cuts[j]).bitwiseOR(block[j])
        keys.append(F.struct(F.lit(band).alias("band"), joined.alias("bits")))
    keyed = prints.select("print", F.inline(F.array(*keys)))
    large = keyed.groupBy("band", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
    chunks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / TILE).cast("int")
    chunk = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(k, F.col("chunk")) * F.col("chunks") + F.greatest(k, F.col("chunk")))
    tiles = (
        keyed.join(large, ["band", "bits"], "left").withColumn("chunks", chunks).withColumn("chunk", chunk)
        .select("band", "bits", F.explode(pair).alias("part"), "print")
    )
    dealt = tiles.repartition("band", "bits", "part").sortWithinPartitions("band", "bits", "part")
    return dealt.mapInPandas(_tile_edges(radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint and link component of every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, text_hash (to tell rows that repeat an id apart), fingerprint (16 hex
    digits), group (a number per component) and component_id, the smallest doc_id reachable over links, itself included.
    A null, empty or blank text has fingerprint zero and is linked like any other. Rows
    that repeat a doc_id are documents of their own. Rows without doc_id link like others; a component has no
    id if none of its rows has one. No rows in, no rows out.
    """
    prints = checkpoint(fingerprints(docs, width))
    firsts = checkpoint(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    found = connected_components(links(firsts, radius))
    grouped = firsts.join(found, firsts["print"] == found["node"], "left").select("print", "first", F.coalesce("component", "print").alias("group"))
    least = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    classes = grouped.join(least, "group").select("print", "group", "component_id")
    return prints.join(classes, "print").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "group", "component_id")


def first_of_each(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, all columns kept.

    The row with the smallest doc_id stays; rows without doc_id come last, and rows that
    repeat an id are told apart by a hash of their text. Rows that repeat both are one.
    """
    return first_rows(docs, near_duplicates(docs, width, radius))


def first_rows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The first row of each ``group`` of ``marked`` (doc_id, text_hash, group), with all columns of ``docs``."""
    chosen = (
        marked.groupBy("group")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("_row"))
        .select(F.col("_row.doc_id").alias("_id"), F.col("_row.text_hash").alias("_hash"))
    )
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_of"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    same = rows["_of"].eqNullSafe(chosen["_id"]) & (rows["_text"] == chosen["_hash"])
    return rows.join(chosen, same, "left_semi").dropDuplicates(["_of", "_text"]).select("_row.*")
