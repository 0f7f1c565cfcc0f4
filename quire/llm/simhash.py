"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint's 64 bits are four blocks of 16. Of up to three differing bits, at least one block has
none (pigeonhole), and of the other 48 bits' two segments of 23 at least one has at most one. So a
fingerprint is found under (error-free block, index of the codeword nearest to a segment): it is filed
under the indexes of all words within a bit of its segments (one or six each) and looked up under its
segments' own. Candidates that share a key are verified on all 64 bits. Keys have 28 bits, and a pair is
kept only under its first fitting key, so no pair is made twice.

Equal fingerprints are one node, so copies are never paired. A fingerprint has at most 43,744 others
within three bits, whatever the number of rows, and the join that verifies them spills and is split at
hot keys by adaptive execution.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and are linked
like any other. Rows with a null id get their component's id, null if no row of it has an id. Repeated
rows are in the same component. An empty table gives an empty one. Other columns are not read, so names
can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import golay
from quire.llm.common import map_rows, table, written
from quire.llm.components import components

SEED, BLOCKS, SEGMENTS, MAX_BITS = 42, 4, 2, 3
#: How often bit j is set in byte value v.
BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
PLACE = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased (A-Z) text's n-word shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([hashed(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[: 1 - n].tolist(), (starts[n:] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit j is set if over half of the hashes have it."""
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + PLACE
        counts += np.bincount(part.ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ BIT) > len(hashes)).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprint_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: id, fp (the fingerprint as a signed long)."""
    kind = df.select(id_col).dtypes[0][1]

    def kernel(keys: list, texts: list) -> tuple:
        found = np.array([fingerprint(shingle_hashes(t or "", shingle)) for t in texts], np.uint64)
        return keys, found.view(np.int64)

    return map_rows(df.select(id_col, text_col), kernel, f"`{id_col}` {kind}, fp long")


def _blocks(fp: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(block, segments of the other bits) for each of the four blocks."""
    out = []
    for b in range(BLOCKS):
        block = (fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)
        low = fp & np.uint64((1 << 16 * b) - 1)
        rest = low | (fp >> np.uint64(16 * (b + 1)) << np.uint64(16 * b) if b < BLOCKS - 1 else np.uint64(0))
        out.append((block, [(rest >> np.uint64(23 * s)) & np.uint64((1 << 23) - 1) for s in range(SEGMENTS)]))
    return out


def _keys(fp: np.ndarray, filed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): what fingerprints are filed under, or looked up under."""
    rows, keys = [], []
    for b, (block, segments) in enumerate(_blocks(fp)):
        for s, segment in enumerate(segments):
            row, index = golay.near(segment) if filed else (np.arange(len(fp)), golay.decode(segment))
            rows.append(row)
            keys.append((b * SEGMENTS + s << 28) | (block[row].astype(np.int64) << 12) | index.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame, filed: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
                rows, keys = _keys(fp.view(np.uint64), filed)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "filed" if filed else "fp"])

    return fps.select("fp").mapInArrow(run, f"key long, {'filed' if filed else 'fp'} long")


def _first_fit(x: str) -> str:
    """SQL: the number (block * 2 + segment) of the first key that a pair with difference x shares."""
    cases = []
    for b in range(BLOCKS):
        low = (1 << 16 * b) - 1
        rest = f"(({x} & {low}L) | (shiftleft(shiftrightunsigned({x}, {16 * (b + 1)}), {16 * b})))" if b < BLOCKS - 1 else f"({x} & {low}L)"
        cases.append(f"WHEN ({x} & shiftleft(65535L, {16 * b})) = 0 THEN {2 * b} + IF(bit_count({rest} & {(1 << 23) - 1}L) <= 1, 0, 1)")
    return f"CASE {' '.join(cases)} END"


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) at most three bits apart, each once."""
    x = "(fp ^ filed)"
    # keys are sized as fingerprints are, of which each has dozens: without the hint Spark may broadcast them
    pairs = _keyed(fps, False).join(_keyed(fps, True).hint("merge"), "key").where(f"fp < filed AND bit_count{x} <= {MAX_BITS} AND shiftright(key, 28) = {_first_fit(x)}")
    return pairs.select(F.col("fp").alias("a"), F.col("filed").alias("b"))


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: id, fp, component_id (the least id reachable over links of at most three bits)."""
    docs = written(fingerprint_texts(df, id_col, text_col, shingle), "fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = components(fingerprint_links(fps))
    linked = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(named, "root").select("fp", "component_id")
    return docs.join(classes, "fp").select(id_col, "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    d = near_classes(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similarity of shingle sets. Three of 64 bits is far stricter than a Jaccard similarity of 0.8, whose
# pairs differ in about ten bits, so fingerprints alone can't find them; bands of minima join them here.
BANDS, BAND_ROWS = 30, 7
#: Shingles and nodes of a block: two blocks are compared by one task at a time.
BLOCK_SHINGLES, BLOCK_NODES = 200_000, 256
MULTIPLIERS = (np.random.default_rng(7).integers(1, 1 << 63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def band_keys(distinct: np.ndarray) -> list[int]:
    """A 64-bit key for each band of the set's minima."""
    import xxhash

    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(distinct), 2048):
        least = np.minimum(least, (MULTIPLIERS * distinct[None, at : at + 2048]).min(axis=1))
    bands = least.reshape(BANDS, BAND_ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(b.tobytes(), i)).astype(np.int64)) for i, b in enumerate(bands)]


def _sketches(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Per row: id, mark (a hash of the text), node (of its set of shingles), fp, bands, shingles."""

    def kernel(keys: list, marks: list, texts: list) -> tuple:
        import xxhash

        nodes, fps, bands, sets = [], [], [], []
        for t in texts:
            hashes = shingle_hashes(t or "", shingle)
            distinct = np.unique(hashes)
            nodes.append(xxhash.xxh3_128_hexdigest(distinct.tobytes()))
            fps.append(int(np.uint64(fingerprint(hashes)).astype(np.int64)))
            bands.append(band_keys(distinct) if len(distinct) else [])
            sets.append(np.unique((distinct >> np.uint64(32)).astype(np.uint32)).tobytes())
        return keys, marks, nodes, fps, bands, sets

    kind = df.select(id_col).dtypes[0][1]
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    return map_rows(rows, kernel, f"id {kind}, mark long, node string, fp long, bands array<long>, shingles binary")


#: A group's nodes are compared if their sides differ, or if one is of both.
ONE, OTHER, BOTH = 0, 1, 2


def _spanning_links(similarity: float):
    """For a group's nodes, sides and shingles: links of similarity or more that connect what such links
    connect. Nodes of one label are known to be connected; a node is compared only with those that no
    link has connected it to so far, so a group of copies takes one pass over its sets."""

    def run(part):
        import pandas as pd

        part = part.sort_values("node", kind="stable")
        nodes, side = part["node"].tolist(), part["side"].to_numpy()
        tree = np.unique(part["label"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(x, np.uint32) for x in part["shingles"]]
        sizes = np.array([len(s) for s in sets])
        own, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        holders = owner[np.argsort(code, kind="stable")]
        ends = np.cumsum(np.bincount(code, minlength=len(own)))
        starts = ends - np.bincount(code, minlength=len(own))
        edges, links = np.cumsum([0, *sizes]), []
        for x in range(len(sets)):
            open_ = (tree != tree[x]) & ((side != side[x]) | (side == BOTH))
            open_[: x + 1] = False
            if not open_.any():
                continue
            codes = code[edges[x] : edges[x + 1]]
            common = np.zeros(len(sets), np.int64)
            for at in range(0, len(codes), 4096):  # at most so many times the group's nodes at once
                c = codes[at : at + 4096]
                lens = ends[c] - starts[c]
                places = np.repeat(starts[c] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
                common += np.bincount(holders[places], minlength=len(sets))
            near = open_ & (common >= similarity * (sizes[x] + sizes - common) - 1e-9)
            for y in np.flatnonzero(near):
                if tree[y] != tree[x]:
                    tree[tree == tree[y]] = tree[x]
                    links.append((nodes[x], nodes[y]))
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _deal(nodes: DataFrame, prefix: str) -> DataFrame:
    """nodes (root, node, n) with a block of bounded size, and of how many blocks of its cluster."""
    sized = nodes.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK_NODES, F.col("shingles") / BLOCK_SHINGLES, F.lit(1))).cast("int")
    d = nodes.join(sized.select("root", blocks.alias(f"{prefix}of")), "root")
    return d.withColumn(f"{prefix}block", F.pmod(F.xxhash64("node"), F.col(f"{prefix}of")).cast("int"))


def similar_classes(sketches: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of all nodes that have a link of the given Jaccard similarity or more.

    Nodes that share a band or whose fingerprints are linked are first joined to clusters, by stars. A
    cluster's links are then found exactly, by tasks that compare two blocks of bounded size and return a
    spanning forest. First, each block is compared with itself and with one block, the leaders, which are
    drawn by a hash; that is linear in the cluster, and connects most of it. Then only the nodes outside
    the largest class so found are compared with all blocks.
    """
    reps = written(sketches.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first(F.length("shingles") / 4).alias("n")), "nodes")
    banded = reps.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    # thirty rows a node, which Spark sizes as one
    stars = banded.hint("merge").join(hubs, "band").where("a != node").select("a", F.col("node").alias("b"))
    by_fp = written(reps.groupBy("fp").agg(F.min("node").alias("a")), "fingerprints")
    same = reps.join(by_fp, "fp").where("a != node").select("a", F.col("node").alias("b"))
    near = fingerprint_links(by_fp).alias("l").join(by_fp.alias("x"), F.expr("l.a = x.fp")).join(by_fp.alias("y"), F.expr("l.b = y.fp"))
    near = near.select(F.col("x.a").alias("a"), F.col("y.a").alias("b"))
    clusters = components(stars.unionByName(same).unionByName(near)).join(reps.select("node", "n"), "node")
    dealt = _deal(clusters, "")
    sets = written(sketches.select("node", "shingles").join(dealt, "node").groupBy("node", "root", "n", "of", "block").agg(F.first("shingles").alias("shingles")), "sets")
    # the leaders are block 0: they go to every task of their cluster, and are compared with one another in the first
    first, last = F.least(F.lit(1), F.col("of") - 1), F.col("of") - 1
    to = F.explode(F.when(F.col("block") == 0, F.sequence(first, last)).otherwise(F.array("block")))
    side = F.when((F.col("block") == 0) & (F.col("task") > 1), OTHER).otherwise(BOTH)
    tasks = sets.withColumn("task", to).select("root", "node", F.col("node").alias("label"), side.alias("side"), "shingles", "task")
    links = written(tasks.groupBy("root", "task").applyInPandas(_spanning_links(similarity), "a string, b string"), "links")
    classes = components(links)
    several = sets.where("of > 1").join(classes.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")).drop("shingles")
    counts = several.groupBy("root", "label").agg(F.count("*").alias("k"))
    largest = counts.groupBy("root").agg(F.max(F.struct("k", "label")).alias("m")).select("root", F.col("m.label").alias("main"))
    marked = written(several.join(largest, "root"), "marked")
    rest = written(_deal(marked.where("label != main").select("root", "node", "n", "label"), "r_"), "rest")
    if not rest.take(1):
        return classes
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # of the cluster, all nodes; and a cluster's number of rest blocks, of which there is one at least
    per = rest.groupBy("root").agg(F.first("r_of").alias("r_of"))
    others = marked.select("root", "node", "label", "block").join(per, "root").select("root", "node", "label", F.lit(OTHER).alias("side"), "block", numbers("r_of").alias("r_block"))
    ones = rest.join(sets.select("node", "of"), "node").select("root", "node", "label", F.lit(ONE).alias("side"), numbers("of").alias("block"), "r_block")
    tasks = others.unionByName(ones).hint("merge").join(sets.select("node", "shingles"), "node")  # a node is sized as one row
    more = tasks.groupBy("root", "block", "r_block").applyInPandas(_spanning_links(similarity), "a string, b string")
    return components(links.unionByName(more))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df without near-duplicates: of each class, joined by links of the given Jaccard
    similarity of word shingles, the row with the least id stays (of those, that with the least hash).

    Texts without words are copies of one another. Of repeated rows one stays, whichever, as they
    differ at most in columns that aren't compared. Sets are of the hashes' first 32 bits: of two sets of a
    thousand shingles, one shingle in four million is taken for another's.
    """
    sketches = written(_sketches(df, id_col, text_col, shingle), "sketches")
    roots = similar_classes(sketches, similarity)
    rows = sketches.select("id", "mark", "node").join(roots, "node", "left").select("id", "mark", F.coalesce("root", "node").alias("root"))
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("k")).select("k.*")
    copies = rows.groupBy("id", "mark").agg(F.count("*").alias("copies"))
    key = [F.col("stays.id").eqNullSafe(F.col("copies.id")), F.col("stays.mark") == F.col("copies.mark")]
    kept = stays.alias("stays").join(copies.alias("copies"), key[0] & key[1]).select(F.col("stays.id").alias("_kept_id"), F.col("stays.mark").alias("_kept_mark"), F.col("copies").alias("_copies"))
    kept = written(kept, "kept")
    marked = df.withColumn("_mark", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    found = marked.join(kept, F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.col("_mark") == F.col("_kept_mark")))
    once = found.where("_copies = 1").select(df.columns)
    again = found.where("_copies > 1").dropDuplicates([c for c in (id_col, "_mark")]).select(df.columns)
    return once.unionByName(again)
