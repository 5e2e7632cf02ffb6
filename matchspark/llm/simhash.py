"""Near-duplicate documents by SimHash fingerprints, compared exactly in tiles.

A fingerprint has 64 bits; a bit is set if it is set in over half of the hashes
(XXH64) of a text's word shingles, repeats included. Fingerprints that differ in
at most ``radius`` bits are linked, and linked documents form components.

Distinct fingerprints are compared, so that copies cost nothing here. They are
grouped by the population counts of their ``parts`` equal parts and cut by hash
into tiles of about ``tile`` fingerprints, whatever a group's size. Two
fingerprints within the radius have counts that differ by the radius or less,
summed over the parts, so each tile meets only those tiles whose counts are as
near (half of them, as pairs have no order); the other pairs of tiles are
skipped. A pair of tiles is one row: numpy takes exclusive-ors and bit counts of
one tile's slices against the other.

Links. A pair of tiles gives a forest with the components of its links, not all
of them: a fingerprint that a link reaches is compared once with those not yet
reached, and dropped from the rest. So a family of n near copies gives fewer
than n edges a pair of tiles.

Cost. Exact comparison is quadratic in the distinct fingerprints by nature. With
4 parts about one pair in twenty is compared, and a tile is sent to 65 groups
(520 bytes a fingerprint); with 8 parts one in 500, for 417 groups. ``parts``
belongs to the caller and changes no result.

Defined results. A-Z are lower-cased; a text of fewer words than a shingle is
hashed as one sequence; null, empty and blank texts have fingerprint zero, which
is linked like any other. ``doc_id`` may repeat. A row without id links others
as any row does, and its component is named by the ids in it (null where there
are none). Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._components import components
from matchspark.llm._tables import drop_kept, keep, table
from matchspark.llm._text import blocks

SHINGLE, RADIUS, SEED = 3, 3, 42
PARTS, TILE = 4, 8192
#: Hashes whose bits are counted at a time, and rows of a tile that one product takes.
COUNTED, SLICE = 1 << 15, 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, with repeats, in arrays of at most COUNTED."""
    from xxhash import xxh64_intdigest

    w = raw.translate(_LOWER).split()
    if not w:
        return
    text = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    width = min(shingle, len(w))
    starts, ends = starts[: len(w) - width + 1], ends[width - 1 :]
    for at in range(0, len(starts), COUNTED):
        s, e = starts[at : at + COUNTED].tolist(), ends[at : at + COUNTED].tolist()
        yield np.fromiter((xxh64_intdigest(text[i:j], SEED) for i, j in zip(s, e)), np.uint64, len(s))


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(raw, shingle):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, buf, offsets in blocks(batch.column(1)):
                b = offsets.tolist()
                fps = np.array([fingerprint(buf[s:e].tobytes(), shingle) for s, e in zip(b, b[1:])], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(fps)), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def as_hex(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def part_counts(fp: Column, parts: int) -> Column:
    """The population counts of the equal parts of a fingerprint, as one number with a byte a part."""
    width = 64 // parts
    count = lambda i: F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1) if parts > 1 else F.lit(-1))).cast("long")
    out = count(0)
    for i in range(1, parts):
        out = out.bitwiseOR(F.shiftleft(count(i), 8 * i))
    return out


def neighbour_steps(parts: int, radius: int) -> list[list[int]]:
    """Half of the differences of part counts whose absolute values sum to the radius or less, and that of nothing."""
    out: list[list[int]] = [[]]
    for _ in range(parts):
        out = [[*x, d] for x in out for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return sorted(x for x in out if x >= [0] * parts)


def _near(block: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """How many of the others are within the radius of each value of a block."""
    return (np.bitwise_count(block[:, None] ^ others[None, :]) <= radius).sum(axis=1)


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (x, y) from distinct values of one tile to those of another, whose components are those of all such links.

    ``left`` and ``right`` hold what no link has reached yet.
    """
    found: list[tuple[int, int]] = []
    while len(left) and len(right):
        block = left[:SLICE]
        near = _near(block, right, radius) > 0
        left = np.concatenate([block[near], left[SLICE:]])  # whom the others are near has been reached, and has been compared with them
        for x in block[near]:
            if x not in left[:SLICE]:
                continue
            left = left[left != x]
            queue = [(x, True)]
            while queue:
                v, from_left = queue.pop()
                others = right if from_left else left
                hit = np.bitwise_count(v ^ others) <= radius
                if hit.any():
                    found += [(int(v), int(y)) for y in others[hit]]
                    queue += [(y, not from_left) for y in others[hit]]
                    left, right = (left, right[~hit]) if from_left else (left[~hit], right)
    return found


def own_links(rest: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (x, y) between distinct values of one tile, whose components are those of all such links."""
    found: list[tuple[int, int]] = []
    while len(rest) > 1:
        block = rest[:SLICE]
        near = _near(block, rest, radius) > 1  # each value is near itself
        rest = np.concatenate([block[near], rest[SLICE:]])
        for x in block[near]:
            if x not in rest[:SLICE]:
                continue
            rest = rest[rest != x]
            queue = [x]
            while queue:
                v = queue.pop()
                hit = np.bitwise_count(v ^ rest) <= radius
                if hit.any():
                    found += [(int(v), int(y)) for y in rest[hit]]
                    queue += list(rest[hit])
                    rest = rest[~hit]
    return found


def links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) of distinct fingerprints whose components are those of all pairs within the radius."""
    if parts not in (1, 2, 4, 8):
        raise ValueError("a fingerprint has 1, 2, 4 or 8 equal parts")
    coded = fps.select("fp", part_counts(F.col("fp"), parts).alias("key"))
    # at most (64 / parts + 1) ** parts groups
    groups = keep(coded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "groups")
    sized = coded.hint("merge").join(groups, "key").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiles = keep(sized.groupBy("key", "t").agg(F.collect_list("fp").alias("fps")), "tiles")  # about ``tile`` values each, by hash
    steps = neighbour_steps(parts, radius)
    width = 64 // parts
    digit = lambda i: F.shiftrightunsigned("key", 8 * i).bitwiseAND(F.lit(255))
    moved = [F.array(*(digit(i) + d for i, d in enumerate(step))) for step in steps]
    near = F.filter(F.array(*moved), lambda x: F.forall(x, lambda c: (c >= 0) & (c <= width)))
    number = lambda x: F.aggregate(F.reverse(x), F.lit(0).cast("long"), lambda s, c: s * 256 + c)
    towards = tiles.select("key").distinct().select("key", F.explode(F.transform(near, number)).alias("other"))
    towards = towards.hint("merge").join(groups.select(F.col("key").alias("other"), "tiles"), "other")
    towards = keep(towards, "towards")
    met = tiles.withColumnRenamed("fps", "own").hint("merge").join(towards, "key").select("key", "t", "own", "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u")).where("key <> other or t <= u")
    pairs = met.hint("merge").join(tiles.select(F.col("key").alias("other"), F.col("t").alias("u"), "fps"), ["other", "u"]).select((F.expr("key = other and t = u")).alias("same"), "own", "fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, fps_ = batch.column(1), batch.column(2)
            found: list[tuple[int, int]] = []
            for r, same in enumerate(batch.column(0).to_pylist()):
                a = own[r].values.to_numpy().view(np.uint64)
                found += own_links(a, radius) if same else tile_links(a, fps_[r].values.to_numpy().view(np.uint64), radius)
            out = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    edges = keep(pairs.mapInArrow(compare, "a long, b long"), "edges")
    drop_kept(groups, tiles, towards)
    return edges


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint and component_id: the smallest doc_id that links lead to, itself included."""
    marked = keep(fingerprints(docs, shingle), "fingerprints")
    classes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    edges = links(classes, radius, parts)
    linked = components(edges)
    least = keep(linked.hint("merge").join(classes, F.col("id") == F.col("fp")).groupBy("root").agg(F.min("rep").alias("least")), "least")
    named = linked.hint("merge").join(least, "root").select(F.col("id").alias("fp"), "least")
    known = keep(classes.hint("merge").join(named, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "rep").alias("component_id")), "named")
    out = marked.hint("merge").join(known, F.col("fp") == F.col("_fp"))
    drop_kept(classes, edges, linked, least)
    return out.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op12_simhash": op12_simhash}
ORACLE_SQL: dict[str, str] = {}
