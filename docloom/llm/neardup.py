"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. Texts are collapsed to distinct ones by SHA-256; a text's least doc_id represents it.
2. Each text's set of hashed five-word shingles (lower-cased words; a text of one to four
   words has one shingle) is sketched by ``bands * rows`` minima.  ``choose_bands`` picks
   the counts so that a pair at the threshold shares a band with ``recall`` probability.
3. Band hashes are shuffled; each bucket yields star edges to its least member, never its
   pairs.  The components of these edges hold every candidate pair.
4. Within a component all pairs are verified exactly on the full shingle sets, block
   against block of at most ``BLOCK`` texts; a block pair returns the number of links per
   text and a spanning forest of the links, so rows stay in proportion to members.
5. Components of the verified links are the classes.

Result, one row per input row: doc_id, class_id (least doc_id of the class), n_links
(other distinct texts with similarity of at least the threshold), n_copies (rows with
exactly this text).

Texts are nodes under a 64-bit hash of their SHA-256; the few whose hash another text has
get another number, so no text is ever lost to one.  Null texts count as empty; texts without
words link to nothing but their exact copies.  Repeated rows are copies of one another.  A
null doc_id never represents a class that has another id.  Ties (equal least ids) go to the
least text hash.  Texts may have any length; all their shingles count.  An empty table gives
no rows.  Other columns are ignored, whatever their names, and come back as they are from
``one_per_class``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textbatch as tb
from docloom.llm.components import components
from docloom.llm.tables import quoted, table, whole_row, written

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 128
BLOCK = 256
_COLUMNS = 1 << 14


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band that reach the recall at the threshold within the hash budget."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band count reaches this recall within max_hashes")
    return best


def _shingles(buf: np.ndarray, off: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of n rows, row after row, and the row bounds."""
    low, start, end, row = tb.words(buf, off)
    h, bound = tb.span_hashes(low, start, end), tb.group_bounds(row, n)
    grams = tb.gram_hashes(h, size)
    keep = np.flatnonzero(row[: len(grams)] == row[size - 1 :][: len(grams)])
    n_words = np.diff(bound)
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    rest = np.array([tb.gram_hashes(h[bound[r] : bound[r + 1]], int(n_words[r]))[0] for r in few], np.uint64)
    rows = np.concatenate([row[keep], few])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([grams[keep], rest])[order], tb.group_bounds(rows[order], n)


def _band_hashes(grams: np.ndarray, bound: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each row that has shingles (rows without any must be left out)."""
    rng = np.random.default_rng(20240607)
    mult = rng.integers(1 << 62, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    heads = bound[:-1]
    out = np.empty((len(heads), bands), np.uint64)
    work = np.empty(len(grams), np.uint64)
    for b in range(bands):
        acc = np.full(len(heads), b + 1, np.uint64)
        for r in range(rows):
            np.multiply(grams, mult[b * rows + r], out=work)
            work += add[b * rows + r]
            acc = tb.mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(work, heads))
        out[:, b] = acc
    return out


def signatures(docs: DataFrame, bands: int, rows: int, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, bands): text_key is the text's SHA-256, bands is empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.text_runs(batch.column(2)):
                grams, bound = _shingles(buf, off, j - i, size)
                some = np.flatnonzero(np.diff(bound))
                counts = np.zeros(j - i, np.int64)
                counts[some] = bands
                values = np.zeros(0, np.int64)
                if len(some):
                    values = tb.signed(_band_hashes(grams, np.append(bound[some], bound[-1]), bands, rows).ravel())
                lists = tb.arrow_lists(values, np.concatenate([[0], np.cumsum(counts)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["doc_id", "text_key", "bands"])

    return docs.mapInArrow(tb.frugal(run), "doc_id long, text_key binary, bands array<long>")


def _links(sizes: np.ndarray, values: np.ndarray, bound: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard similarity of at least the threshold."""
    n = len(sizes)
    common = np.zeros((n, n), np.float32)
    row = np.repeat(np.arange(n), np.diff(bound))
    seen, col = np.unique(values, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, len(seen), _COLUMNS):
        a, b = np.searchsorted(col, (lo, lo + _COLUMNS))
        part = np.zeros((n, min(_COLUMNS, len(seen) - lo)), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        common += part @ part.T
    need = threshold * (sizes[:, None] + sizes[None, :]) / (1 + threshold)
    linked = common >= need - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    n = len(linked)
    label = np.arange(n)
    while True:
        nxt = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt


def _verify_block(node: np.ndarray, side: np.ndarray, same: bool, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(node, kind="stable")
    node, side, sets = node[order], side[order], [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets], np.float64)
    bound = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    linked = _links(sizes, np.concatenate(sets) if sets else np.zeros(0, np.int64), bound, threshold)
    if not same:
        linked &= side[:, None] != side[None, :]
    return node, linked.sum(axis=1), node[_roots(linked)]


def verified_links(sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, n_links, root) per node and block pair; ``sets`` has comp, node, grams, blocks (of the component)."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    keyed = spread.select("comp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _sorted_groups(batches, 3):
            node = np.array([r[1] for r in rows], np.int64)
            side = np.array([r[0] for r in rows], np.int64)
            got = _verify_block(node, side, key[1] == key[2], [r[2] for r in rows], threshold)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], names=["node", "n_links", "root"])

    dealt = keyed.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    return dealt.mapInArrow(tb.frugal(run), "node long, n_links long, root long")


def _sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of a partition sorted by its first columns; the rest of a row is (mine, node, grams)."""
    key, rows = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys))))
        mine, node = batch.column(n_keys).to_pylist(), batch.column(n_keys + 1).to_pylist()
        grams = batch.column(n_keys + 2)
        flat, off = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
        for i, k in enumerate(keys):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append((mine[i], node[i], flat[off[i] : off[i + 1]].copy()))
    if rows:
        yield key, rows


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(comp, node, blocks, grams): distinct shingle hashes of each text; docs has comp, node, blocks, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.text_runs(batch.column(3)):
                grams, bound = _shingles(buf, off, j - i, size)
                sets = [np.unique(grams[bound[r] : bound[r + 1]]) for r in range(j - i)]
                lists = tb.arrow_lists(tb.signed(np.concatenate(sets)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in range(3)] + [lists], names=["comp", "node", "blocks", "grams"])

    return docs.mapInArrow(tb.frugal(run), "comp long, node long, blocks long, grams array<long>")


def numbered(texts: DataFrame, key: str = "text_key", bits: int = 64) -> DataFrame:
    """Adds ``node``, a 64-bit number of its own for each row: a hash, and another one for the few whose hash an earlier key has.

    ``bits`` narrows the first hash, for tests.
    """
    first = F.xxhash64(key) if bits == 64 else F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    hashed = texts.withColumn("node", first)
    shared = written(hashed.groupBy("node").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1"), "shared-nodes")
    left = written(hashed.join(shared, "node").filter(F.col(key) != F.col("first")).select(key), "renumbered")
    done = left.select(key, F.lit(0).cast("long").alias("own")).limit(0)
    for turn in count(1):
        if left.isEmpty():
            break
        tried = left.select(key, F.xxhash64(key, F.lit(turn)).alias("own"))
        free = tried.join(hashed.select(F.col("node").alias("own")), "own", "left_anti").join(done.select("own"), "own", "left_anti")
        now = written(free.groupBy("own").agg(F.min(key).alias(key)).select(key, "own"), "renumbered")
        done = done.union(now)
        left = written(left.join(now, key, "left_anti"), "renumbered")
    return hashed.join(done, key, "left").withColumn("node", F.coalesce("own", "node")).drop("own")


def _text_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE, max_hashes: int = MAX_HASHES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of each row, and (text_key, rep, root, n_links, n_copies) of each distinct text."""
    bands, rows = choose_bands(threshold, recall, max_hashes)
    text = F.coalesce(quoted(text_col), F.lit(""))
    keyed = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text"))
    sigs = written(signatures(keyed, bands, rows, size), "minhash")
    plain = written(sigs.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "texts")
    reps = written(numbered(plain), "nodes")
    # a text's representative may be named by several rows: nodes are per text, not per doc_id
    own = reps.select("node", "rep", F.col("text_key").alias("k"))
    one = sigs.join(own, (sigs["text_key"] == own["k"]) & sigs["doc_id"].eqNullSafe(own["rep"])).select("node", "bands").dropDuplicates(["node"])
    banded = one.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = banded.join(buckets, ["band", "hash"]).filter("node <> centre").select("node", "centre").distinct()
    candidates = components(stars).withColumnRenamed("root", "comp")
    sized = candidates.groupBy("comp").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks"))
    members = candidates.join(sized, "comp")
    of_text = reps.select("node", "rep", "text_key").join(members, "node")
    texts = keyed.join(of_text.withColumnRenamed("text_key", "k"), keyed["doc_id"].eqNullSafe(of_text["rep"]) & (keyed["text_key"] == F.col("k")))
    texts = texts.select("comp", "node", "blocks", "text").dropDuplicates(["node"])
    links = written(verified_links(shingle_sets(texts, size), threshold, block), "links")
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    classes = components(links.select("node", "root"))
    nodes = reps.join(counts, "node", "left").join(classes, "node", "left")
    return sigs.select("doc_id", "text_key"), nodes.select("text_key", "rep", F.coalesce("root", "node").alias("root"), "n_links", "n_copies")


def jaccard_classes(docs: DataFrame, **options: object) -> DataFrame:
    """Classes of near-duplicate texts; see the module's text for the columns, ``_text_nodes`` for the options."""
    rows, nodes = _text_nodes(docs, **options)
    least = nodes.groupBy("root").agg(F.min("rep").alias("class_id"))
    nodes = nodes.join(least, "root").select("text_key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return rows.join(nodes, "text_key").select("doc_id", "class_id", "n_links", "n_copies")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs that stand for their class: one row with the least id of each (null ids last), and of that the least text hash.

    Classes are told apart by their texts, so an id that names several texts loses none of
    their classes, and rows without an id are judged by their texts like all others.  Of
    equal ids and texts the least row stays, so columns must have an order.
    """
    _, nodes = _text_nodes(docs, id_col=id_col, text_col=text_col, **options)
    first = nodes.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "text_key")).alias("kept"))
    kept = first.select(F.col("kept.rep").alias("kept_id"), F.col("kept.text_key").alias("kept_key"))
    key = F.unhex(F.sha2(F.coalesce(quoted(text_col), F.lit("")), 256))
    others = F.to_json(F.struct(F.lit(0).alias("_"), quoted(text_col).isNull().alias("none"), whole_row(docs, (text_col,)).alias("row"))) if len(docs.columns) > 1 else F.lit("")
    keyed = docs.select(quoted(id_col).cast("long").alias("own_id"), key.alias("own_key"), whole_row(docs).alias("row"), others.alias("order"))
    named = keyed.join(kept, (F.col("own_key") == F.col("kept_key")) & F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return named.groupBy("own_key").agg(F.min_by("row", "order").alias("row")).select("row.*")


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
