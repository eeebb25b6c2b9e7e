"""SimHash near-duplicates: every pair of distinct fingerprints compared, tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, block_pairs, components, drop_path, dropped, filed, map_texts, part_of, pinned, spread_join

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Fingerprints of a tile at most, and tiles at least (so that small inputs still use several tasks).
TILE = 65_536
MIN_TILES = 8
#: Tiles of a block: a task holds two blocks and compares their tiles. Blocks are smaller while there are fewer than BLOCKS of them.
BLOCK = 16
BLOCKS = 12
#: Tasks that compare blocks, at most; a task with several pairs takes one after another.
MOST_TASKS = 20_000


def fingerprint_words(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the space-joined shingles; with fewer words than ``size`` the whole sequence is one shingle."""
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=n)


def _fingerprints():
    def work(texts):
        out = []
        for t in texts:
            words = (t or b"").lower().split()
            if not words:
                out.append(0)
                continue
            h = fingerprint_words(words)
            counts = np.zeros(64, dtype=np.int64)
            for i in range(0, len(h), 65_536):
                part = h[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            out.append(int(np.packbits(2 * counts > len(h)).view(">u8")[0].astype(np.int64)))
        return [out]

    return work


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row; null or wordless texts give 0."""
    return map_texts(docs, ["doc_id"], _fingerprints, "fp long")


def _tile_plan(histogram: list[tuple[int, int]], tile: int, least: int) -> dict[int, tuple[int, int]]:
    """Of each population count: (first tile, number of tiles). Neighbouring counts share a tile while it has room."""
    total = sum(n for _, n in histogram)
    room = max(1, min(tile, -(-total // least)))
    plan, at, held = {}, 0, 0
    for pop, n in sorted(histogram):
        if n > room:
            at, held = at + (held > 0), 0
            parts = -(-n // room)
            plan[pop] = (at, parts)
            at += parts
        else:
            if held + n > room:
                at, held = at + 1, 0
            plan[pop] = (at, 1)
            held += n
    return plan


def _partners(plan: dict[int, tuple[int, int]], radius: int) -> list[tuple[int, int, int, int, int]]:
    """Of each population count: first tile, number of tiles, and the first and last tile of counts within the radius of its tiles.

    Tiles are numbered by rising counts, so the partners of a tile are one range; 65 rows at most.
    """
    spans: dict[int, list[int]] = {}
    for pop in plan:
        spans.setdefault(plan[pop][0], []).append(pop)
    out = []
    for pop, (first, parts) in plan.items():
        lo, hi = min(spans[first]) - radius, max(spans[first]) + radius
        near = [(a, a + n - 1) for p, (a, n) in plan.items() if p >= lo and p <= hi]
        # a tile of several counts may hold one in reach though its first is not: tiles are taken whole
        out.append((pop, first, parts, min(a for a, _ in near), max(b for _, b in near)))
    return out


def _near(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Yield (row of a, rows of b within the radius); of equal tiles only later rows of b."""
    pa_, pb = np.bitwise_count(a), np.bitwise_count(b)
    order_b = np.argsort(pb, kind="stable")
    sb, spb = b[order_b], pb[order_b].astype(np.int16)
    high_b = np.bitwise_count(sb >> np.uint64(32)).astype(np.int16)
    order_a = np.lexsort((np.bitwise_count(a >> np.uint64(32)), pa_))
    step, width = 64, 8192
    for i in range(0, len(a), step):
        rows = order_a[i : i + step]
        ra, high_a = a[rows], np.bitwise_count(a[rows] >> np.uint64(32)).astype(np.int16)
        lo, hi = np.searchsorted(spb, [int(pa_[rows].min()) - radius, int(pa_[rows].max()) + radius + 1])
        cols = np.arange(lo, hi)
        cols = cols[(high_b[lo:hi] >= high_a.min() - radius) & (high_b[lo:hi] <= high_a.max() + radius)]
        for j in range(0, len(cols), width):
            part = cols[j : j + width]
            hit = np.bitwise_count(ra[:, None] ^ sb[part][None, :]) <= radius
            for r in np.flatnonzero(hit.any(axis=1)):
                found = order_b[part[hit[r]]]
                if same:
                    found = found[found > rows[r]]
                if len(found):
                    yield int(rows[r]), found


def tile_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, least: int = MIN_TILES) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (column fp) within ``radius`` bits.

    The tiles follow the population count: fingerprints whose counts differ beyond the radius cannot be that near, so such
    tile pairs are never compared. Each tile is written once, as a file of its own; a task opens the tiles of two blocks and
    compares them with exclusive-or and bit counts, so no fingerprint is sent to more than one place. It returns a spanning
    forest of what it found: at most a row for each fingerprint, however large the groups are.
    """
    distinct = distinct.withColumn("pop", F.bit_count("fp").cast("int"))
    histogram = [(r["pop"], r["n"]) for r in distinct.groupBy("pop").agg(F.count("*").alias("n")).collect()]  # 65 rows at most
    spark = distinct.sparkSession
    if not histogram:
        return spark.createDataFrame([], "a long, b long")
    plan = _partners(_tile_plan(histogram, tile, least), radius)
    tiles = max(first + parts for _, first, parts, _, _ in plan)
    block = max(1, min(BLOCK, tiles // BLOCKS))
    #: first and last partner of each tile; 65 kinds of tiles, each a range
    reach = sorted({(first, first + parts - 1, lo, hi) for _, first, parts, lo, hi in plan})
    lows, highs = np.zeros(tiles, np.int64), np.zeros(tiles, np.int64)
    for first, last, lo, hi in reach:
        lows[first : last + 1], highs[first : last + 1] = lo, hi
    # a pair is compared once, by the block of its later tile
    spans = [(i, int(lows[i * block : (i + 1) * block].min()) // block, i) for i in range(-(-tiles // block))]
    tasks = min(MOST_TASKS, max(1, sum(j - i + 1 for _, i, j in spans)))
    plan_rows = spark.createDataFrame([(pop, first, parts) for pop, first, parts, _, _ in plan], "pop int, first int, parts int")  # 65 rows at most
    tiled = distinct.join(F.broadcast(plan_rows), "pop").select("fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).alias("tile"))
    path = filed(tiled.repartition("tile"), "tile", "simhash-tiles")

    def tiles_of(b: int) -> dict[int, np.ndarray]:
        found = {t: part_of(path, "tile", t, ["fp"]) for t in range(b * block, min(tiles, (b + 1) * block))}
        return {t: np.sort(rows["fp"].to_numpy()) for t, rows in found.items() if rows.num_rows}

    def compare(batches):
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left = tiles_of(i)
                right = left if i == j else tiles_of(j)
                every = np.concatenate([*(right.values() if i == j else [*right.values(), *left.values()]), np.zeros(0, np.int64)])
                at = dict(zip([*right, *([] if i == j else left)], np.cumsum([0, *map(len, right.values()), *([] if i == j else map(len, left.values()))])[:-1].tolist(), strict=True))
                forest, touched = Forest(len(every)), np.zeros(len(every), bool)
                for t, a in left.items():
                    for u, b in right.items():
                        if u <= t and lows[t] <= u <= highs[t]:
                            for r, found in _near(a.view(np.uint64), b.view(np.uint64), radius, u == t):
                                ids = np.append(found + at[u], r + at[t])
                                forest.join(ids)
                                touched[ids] = True
                ids = np.flatnonzero(touched)
                roots = forest.roots(ids)
                keep = ids != roots
                yield pa.RecordBatch.from_arrays([pa.array(every[ids[keep]]), pa.array(every[roots[keep]])], names=["a", "b"])

    links = pinned(block_pairs(spark, spans, tasks).mapInArrow(compare, "a long, b long"), "simhash-links")
    drop_path(spark, path)
    return links


def _groups(classes: DataFrame, radius: int) -> DataFrame:
    """fp and group (the smallest fingerprint reachable by links) of ``classes``, which has each fingerprint once."""
    links = tile_links(classes.select("fp"), radius)
    comp = components(links)
    dropped(links)
    return classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text; more columns are ignored).

    Null and wordless texts have fingerprint zero and link like any other. Equal fingerprints meet in one group-by with
    map-side combine; only distinct ones are compared. Repeated doc_ids each keep their row; a group of null doc_ids only has
    a null component_id. An empty table gives no rows.
    """
    marked = pinned(fingerprints(docs), "simhash-fp")
    classes = pinned(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-class")
    # the component of a fingerprint, then the smallest doc_id over its classes
    named = pinned(_groups(classes, radius), "simhash-named")
    least = pinned(named.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "simhash-least")
    # a group may hold any share of the fingerprints, and a fingerprint any share of the rows
    by_fp = pinned(spread_join(named, least, "group", "size", "fp").select("fp", "component_id", "n"), "simhash-groups")
    dropped(classes, named, least)
    return spread_join(marked, by_fp, "fp", "n", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate component of ``docs``, with all its columns: the one with the smallest doc_id.

    A null doc_id comes after all others. Of rows with that doc_id in the component the one with the smallest text hash
    stays; of rows equal in doc_id and text any one. Only ids, hashes and fingerprints are shuffled, and texts of repeated
    rows where there are any.
    """
    cols = docs.columns
    names = [f"__c{i}" for i in range(len(cols))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)], F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    marked = pinned(map_texts(keys, ["doc_id", "hash"], _fingerprints, "fp long"), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first")
    classes = pinned(marked.groupBy("fp").agg(first), "simhash-class")
    chosen = _groups(classes, radius).groupBy("group").agg(F.min("first").alias("first")).select("first.doc_id", "first.hash")
    copies = marked.groupBy(F.col("doc_id").alias("i"), F.col("hash").alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    chosen = chosen.join(copies, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    chosen = pinned(chosen.select("doc_id", "hash", F.col("n").isNotNull().alias("repeated")), "simhash-kept")
    dropped(marked, classes)

    def rows_of(which: DataFrame) -> DataFrame:
        return rows.join(which, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("hash")), "left_semi")

    kept = rows_of(chosen.where("not repeated"))
    if chosen.where("repeated").head(1):
        kept = kept.union(rows_of(chosen.where("repeated")).dropDuplicates(["__id", "__hash"]))
    return kept.select(*[F.col(n).alias(c) for c, n in zip(cols, names, strict=True)])
