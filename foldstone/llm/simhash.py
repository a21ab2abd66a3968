"""SimHash fingerprints and their near-duplicates by a binary trie self-join.

The distinct fingerprints form a binary trie. The join starts at (root, root)
and walks pairs of nodes at the same depth; each step down adds the bits that
differ on the two edges, and a pair is dropped once the sum exceeds the budget.

The walk's upper levels are arithmetic on prefixes: at the depth where a node
holds `node_rows` fingerprints on average, a node meets the nodes whose prefix
differs from its own by a mask within the budget, so a fingerprint is sent to
those pairs of nodes and each pair is walked to the leaves in one task. The
driver sees a histogram of 16-bit prefixes (at most 65,536 counts, whatever the
input) and holds no pairs. A node with more than `node_rows` fingerprints is
cut into blocks by a mixed hash and all pairs of its blocks are walked, so a
task never holds more than two blocks.

Documents with equal fingerprints are one trie leaf, so a group of copies is
one row here. A task returns its links as stars (each fingerprint with the
smallest one reached in this task), which keeps connectivity and bounds the
output by the rows that came in; `components` joins the stars.

Defined results: a text that is null, empty or only white space has the
fingerprint zero and links like any other. Rows sharing a doc_id are separate
documents. A null doc_id is larger than every other one: it is a component's id
only if no document of the component has one (then null). An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm import bloom
from foldstone.llm.components import components, local_roots
from foldstone.llm.shared import arrow_rows, release, stage

#: Nodes are prefixes of FLOOR to TOP_BITS bits, as many as bring NODE_ROWS fingerprints to a node on average.
TOP_BITS, FLOOR, NODE_ROWS = 16, 4, 1 << 17


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `words` words; the whole sequence where there are fewer."""
    # bytes: lower() folds A-Z only, split() cuts at U+0020 and U+0009 to U+000D only
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())), np.uint64, len(tokens) - words + 1)


def word_hashes(text: str | None) -> np.ndarray:
    tokens = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def distinct_runs(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `words` words, made of the words' own hashes: each word is hashed once."""
    words = min(words, len(hashes))
    if not words:
        return hashes
    run = np.zeros(len(hashes) - words + 1, np.uint64)
    for at in range(words):
        run ^= hashes[at : at + len(run)]
        run *= _MULTIPLIERS[at % len(_MULTIPLIERS)]
        run ^= run >> np.uint64(29)
    return np.unique(run)


def fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit: bit b is set if it is set in over half of the shingle hashes."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, rk, fp); rk tells rows that share a doc_id apart unless their texts are equal."""

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        for doc in each:
            yield doc["doc_id"], doc["rk"], fingerprint(doc["text"], words)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rk"))
    return arrow_rows(picked, "doc_id long, rk long, fp long", rows, 16384)


def allowance(budget: int, rotations: int) -> list[int]:
    """Bits that may differ in the first d bits, d = 0 to 64.

    With rotations, the fingerprint is cut into as many equal blocks, and the trie is walked once for each block in
    front. Two fingerprints within the budget have some rotation in which no run of leading blocks holds more than its
    share of it (the cycle lemma), so pruning by that share loses no link.
    """
    block = 64 // rotations
    return [budget * -(-d // block) // rotations for d in range(65)]


def _walk(a: np.ndarray, b: np.ndarray, same: bool, allowed: list[int], bits: int = 64, leaf: int = 32, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of two sorted uint64 arrays whose values differ in at most allowed[64] bits; i < j where same."""
    if not len(a) or not len(b):
        return
    one = np.array
    todo = [(0, one([0]), one([len(a)]), one([0]), one([len(b)]), one([0]))]
    while todo:
        depth, alo, ahi, blo, bhi, d = todo.pop()
        size = (ahi - alo) * (bhi - blo)
        small = (size <= leaf) | (depth == bits)
        if small.any():
            yield from _leaves(a, b, same, allowed[bits], *(x[small] for x in (alo, ahi, blo, bhi)), chunk)
        alo, ahi, blo, bhi, d = (x[~small] for x in (alo, ahi, blo, bhi, d))
        if not len(alo):
            continue
        shift = np.uint64(bits - 1 - depth)
        amid, bmid = _middle(a, shift, alo, ahi), _middle(b, shift, blo, bhi)
        twin = same & (alo == blo)
        kids = [(alo, amid, blo, bmid, d), (amid, ahi, bmid, bhi, d), (alo, amid, bmid, bhi, d + 1)]
        kids.append(tuple(x[~twin] for x in (amid, ahi, blo, bmid, d + 1)))
        down = [np.concatenate(x) for x in zip(*kids)]
        alive = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= allowed[depth + 1])
        down = [x[alive] for x in down]
        for start in range(0, len(down[0]), chunk):
            todo.append((depth + 1, *(x[start : start + chunk] for x in down)))


def _middle(values: np.ndarray, shift: np.uint64, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    zeros = np.concatenate(([0], np.cumsum((values >> shift & np.uint64(1)) == 0)))
    return lo + zeros[hi] - zeros[lo]


def _leaves(a, b, same, budget, alo, ahi, blo, bhi, chunk):
    size = (ahi - alo) * (bhi - blo)
    cuts = np.concatenate(([0], np.cumsum(size)))
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(cuts, cuts[start] + chunk, "right")) - 1)
        n = size[start:stop]
        pair = np.repeat(np.arange(start, stop), n)
        k = np.arange(len(pair)) - np.repeat(cuts[start:stop] - cuts[start], n)
        wide = (bhi - blo)[pair]
        i, j = alo[pair] + k // wide, blo[pair] + k % wide
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        yield i[near], j[near]
        start = stop


def trie_links(a: np.ndarray, b: np.ndarray | None, allowed: list[int], near=None) -> tuple[np.ndarray, np.ndarray]:
    """All links between two sorted arrays of fingerprints, or inside one; near(i, j) may reject links."""
    found = []
    for i, j in _walk(a, a if b is None else b, b is None, allowed):
        if near is not None and len(i):
            kept = near(i, j)
            i, j = i[kept], j[kept]
        found.append((i, j))
    return tuple(np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))


class TriePlan:
    """Nodes of the trie at one depth, and the pairs of them that the budget allows, all by arithmetic on prefixes.

    counts: fingerprints per 16-bit prefix, a histogram of fixed size. A node that holds more than node_rows is cut
    into blocks by a mixed hash; a unit of work is a pair of nodes or blocks. Nothing here grows with the pairs.
    """

    def __init__(self, counts: np.ndarray, allowed: list[int], node_rows: int, floor: int):
        n = int(counts.sum())
        self.depth = min(TOP_BITS, max(floor, (max(n - 1, 0) // node_rows).bit_length()))
        size = counts.reshape(1 << self.depth, -1).sum(1)
        self.blocks = -(-size // node_rows)
        self.first = np.concatenate(([0], np.cumsum(self.blocks)))
        masks = np.zeros(1, np.int64)
        for level in range(1, self.depth + 1):
            masks = np.concatenate((masks << 1, masks << 1 | 1))
            masks = masks[np.bitwise_count(masks) <= allowed[level]]
        #: A node meets those whose prefix differs from its own by one of these.
        self.masks = masks

    def units(self, fp: np.ndarray) -> np.ndarray:
        node = (fp >> np.uint64(64 - self.depth)).astype(np.int64)
        return self.first[node] + (_mixed(fp) % np.maximum(self.blocks[node], 1).astype(np.uint64)).astype(np.int64)

    def meetings(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, pair) for every pair of units that each fingerprint takes part in."""
        node, own = (fp >> np.uint64(64 - self.depth)).astype(np.int64), self.units(fp)
        partner = (node[:, None] ^ self.masks[None, :]).ravel()
        n = self.blocks[partner]
        row = np.repeat(np.repeat(np.arange(len(fp)), len(self.masks)), n)
        other = np.repeat(self.first[partner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return row, np.minimum(own[row], other) * self.first[-1] + np.maximum(own[row], other)

    def sides(self, pair: int) -> tuple[int, int]:
        return divmod(pair, int(self.first[-1]))


def _mixed(fp: np.ndarray) -> np.ndarray:
    x = fp * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(7)


def near_links(prints: DataFrame, budget: int, rotations: int = 1, sketch_bits: int | None = None, node_rows: int = NODE_ROWS, floor: int = FLOOR) -> DataFrame:
    """(u, v): a spanning forest, per task, of the links among the rows of prints (node, fp[, sketch array<long>]).

    Rows are linked whose fp differ in at most `budget` bits and, where given, whose sketches differ in at most
    `sketch_bits`. Rows should be distinct in fp and sketch. The trie is split to `floor` levels at least.
    """
    allowed = allowance(budget, rotations)
    turns = [r * (64 // rotations) for r in range(rotations)]
    sketched = sketch_bits is not None
    turned = [F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn)) if turn else F.col("fp") for turn in turns]
    tops = F.explode(F.array([F.shiftrightunsigned(fp, 64 - TOP_BITS) + (k << TOP_BITS) for k, fp in enumerate(turned)])).alias("p")
    counts = np.zeros(rotations << TOP_BITS, np.int64)
    histogram = prints.select(tops).groupBy("p").count().toArrow()  # at most 2**16 rows a rotation
    counts[histogram.column("p").to_numpy()] = histogram.column("count").to_numpy()
    plans = prints.sparkSession.sparkContext.broadcast([TriePlan(c, allowed, node_rows, floor) for c in counts.reshape(rotations, -1)])

    def rotated(part: pa.RecordBatch, turn: int) -> np.ndarray:
        fp = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        return fp << np.uint64(turn) | fp >> np.uint64(64 - turn) if turn else fp

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                columns = []
                if sketched:  # one fixed-width value a row is half the bytes of an array
                    bits = np.ascontiguousarray(part.column("sketch").flatten().to_numpy())
                    ends = np.arange(part.num_rows + 1, dtype=np.int32) * (bits.nbytes // max(part.num_rows, 1))
                    columns.append(pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(bits)]))
                for k, turn in enumerate(turns):
                    fp = rotated(part, turn)
                    row, pair = plans.value[k].meetings(fp)
                    taken = [c.take(pa.array(row)) for c in (part.column("node"), pa.array(fp.view(np.int64)), *columns)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(pair), *taken], names=["turn", "pair", "node", "fp"] + ["sketch"] * sketched)

    def join(table: pa.Table) -> pa.Table:
        t, pair = plans.value[table.column("turn")[0].as_py()], table.column("pair")[0].as_py()
        low, high = t.sides(pair)
        same = low == high
        table = table.sort_by("node")
        fp = table.column("fp").to_numpy().view(np.uint64)
        # the rows of the two units apart, each in the order of node
        order = np.argsort(t.units(fp) != low, kind="stable")
        node, fp = table.column("node").to_numpy()[order], fp[order]
        cut = len(node) if same else int((t.units(fp) == low).sum())
        a, b = np.argsort(fp[:cut], kind="stable"), np.argsort(fp[cut:], kind="stable") + cut
        near = None
        if sketched:
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)[order]
            near = lambda i, j: np.bitwise_count(sketch[a[i]] ^ sketch[(a if same else b)[j]]).sum(1) <= sketch_bits
        i, j = trie_links(fp[a], None if same else fp[b], allowed, near)
        i, j = a[i], (a if same else b)[j]
        root = local_roots(len(node), i, j)
        far = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"u": node[far], "v": node[root[far]]})

    columns = ["node", "fp"] + ["sketch"] * sketched
    sent = prints.select(*columns).mapInArrow(send, "turn int, pair long, node long, fp long" + (", sketch binary" if sketched else ""))
    return sent.groupBy("turn", "pair").applyInArrow(join, "u long, v long")


def simhash_components(prints: DataFrame, budget: int) -> DataFrame:
    """prints (doc_id, fp, …) with component_id, the smallest doc_id reachable."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    found = components(near_links(distinct.select(F.col("fp").alias("node"), "fp"), budget))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp")


#: For one_of_each: the trie's candidates differ in at most CANDIDATE_BITS of the fingerprint of CANDIDATE_WORDS-word shingles.
CANDIDATE_WORDS, CANDIDATE_BITS, ROTATIONS, SKETCHES = 2, 11, 4, 4
#: Candidates too are documents that share a band, BAND_ROWS equal minima out of BANDS * BAND_ROWS: at a similarity of 0.8
#: all bands differ once in 150,000 pairs, wherever the edits are.
BANDS, BAND_ROWS = 30, 5
#: Buckets of up to SMALL nodes list all their pairs; larger ones list each node's NEAREST, then meet in blocks of BLOCK nodes or BLOCK_SHINGLES.
SMALL, BLOCK, NEAREST, BLOCK_SHINGLES = 8, 1024, 2, 1 << 20
#: Odd multipliers that derive the further hashes of a shingle from its first.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_MINIMA = np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 9) | 1 for k in range(BANDS * BAND_ROWS)], np.uint64)


def sketch_limit(similarity: float, sketches: int = SKETCHES) -> int:
    """Bits in which sketches of `similarity` differ on average, and six standard deviations more: a filter, not a verdict."""
    cosine = 2 * similarity / (1 + similarity)  # of shingle sets of like size
    n, p = 64 * sketches, float(np.arccos(cosine) / np.pi)
    return round(n * p + 6 * (n * p * (1 - p)) ** 0.5)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit: bit b is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[start : start + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def bands(hashes: np.ndarray) -> list[int]:
    """One hash per band of minima over a set of shingle hashes."""
    least = np.full(len(_MINIMA), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[start : start + 1024] * _MINIMA[:, None]).min(1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))]


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, rk, a, b, size, fp, sketch, bands) of the distinct shingles, however often each is repeated.

    a and b are a digest of the set of `words`-word shingles, which size, sketch and bands describe; fp is of the shorter ones.
    """

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        for doc in each:
            own = word_hashes(doc["text"])
            hashes = distinct_runs(own, words)
            mixed = [hashes * m for m in _MULTIPLIERS[:SKETCHES]]
            a, b = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64).tolist()
            yield doc["doc_id"], doc["rk"], a, b, len(hashes), majority(distinct_runs(own, CANDIDATE_WORDS)), [majority(h ^ (h >> np.uint64(29))) for h in mixed], bands(hashes)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rk"))
    return arrow_rows(picked, "doc_id long, rk long, a long, b long, size long, fp long, sketch array<long>, bands array<long>", rows, 4096)


def _like(size: np.ndarray, own: int, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity to a set of `own` shingles."""
    return np.minimum(size, own) >= similarity * np.maximum(size, own) - 1e-9


def _words_of(sketches: pa.ChunkedArray, n: int) -> np.ndarray:
    return sketches.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)


def _nearest(limit: int, similarity: float):
    """For one block of a bucket: the NEAREST nodes of like size that each node's sketch is close to, as (u, v)."""

    def propose(table: pa.Table) -> pa.Table:
        node, size = (table.column(c).to_numpy() for c in ("node", "size"))
        sketch = _words_of(table.column("sketch"), len(node))
        out: list[list[np.ndarray]] = [[], []]
        for i in range(len(node)):
            others = np.flatnonzero((node != node[i]) & _like(size, size[i], similarity))
            far = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1)
            others, far = others[far <= limit], far[far <= limit]
            if len(others) > NEAREST:
                others = others[np.argpartition(far, NEAREST)[:NEAREST]]
            for to, x in zip(out, (np.minimum(node[i], node[others]), np.maximum(node[i], node[others]))):
                to.append(x)
        return pa.table({"u": np.concatenate(out[0]), "v": np.concatenate(out[1])})

    return propose


def _texts_of(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """asked (__id, __rk, …) with the texts of those rows; texts that nothing asks for are filtered out before they are shuffled."""
    held = bloom.may_hold(asked.select(F.xxhash64("__id", "__rk").alias("h")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rk")).where(held(F.xxhash64("doc_id", "rk")))
    return texts.join(asked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("rk") == F.col("__rk"))).drop("doc_id", "rk", "__id", "__rk")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): the pairs whose two sets of shingles have the similarity, counted exactly. Two texts meet in the task of their pair."""
    sides = pairs.select("u", "v", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("node")), F.struct(F.lit(1).alias("side"), F.col("v").alias("node")))).alias("s")).select("u", "v", "s.*")
    asked = stage(sides.join(nodes.select("node", "first"), "node").select("u", "v", "side", F.col("first.doc_id").alias("__id"), F.col("first.rk").alias("__rk")), "asked")
    met = _texts_of(asked, docs).select("u", "v", "side", "text")

    def compared(each: Iterator[dict]) -> Iterator[tuple]:
        left, pair, known = np.empty(0, np.uint64), None, None
        for row in each:
            if row["side"] == 0:
                if row["u"] != known:
                    left, known = distinct_runs(word_hashes(row["text"]), words), row["u"]
            elif (row["u"], row["v"]) != pair:  # equal rows of docs meet one node: any of them will do
                pair, right = (row["u"], row["v"]), distinct_runs(word_hashes(row["text"]), words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both >= similarity * (len(left) + len(right) - both) - 1e-9:
                    yield pair

    together = met.repartition("u", "v").sortWithinPartitions("u", "v", "side")
    found = stage(arrow_rows(together, "u long, v long", compared, 8192), "verified")
    release(asked)
    return found


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct hashes of each asked node's text, made once, as bytes."""

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        for row in each:
            yield row["node"], distinct_runs(word_hashes(row["text"]), words).tobytes()

    keys = nodes.join(asked, "node").select("node", F.col("first.doc_id").alias("__id"), F.col("first.rk").alias("__rk"))
    # equal rows of docs meet one node: any of them will do
    return stage(arrow_rows(_texts_of(keys, docs), "node long, shingles binary", rows, 256).groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")


def _counted(limit: int, similarity: float):
    """For two blocks of a bucket: the links between nodes of unlike labels, counted on their sets, as stars of labels (u, v)."""

    def count(table: pa.Table) -> pa.Table:
        label, size, block = (table.column(c).to_numpy() for c in ("label", "size", "block"))
        sketch = _words_of(table.column("sketch"), len(label))
        low = table.column("low")[0].as_py()
        same = low == table.column("high")[0].as_py()
        held = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64)
        values, at = np.unique(held, return_inverse=True)
        ends = np.cumsum(size)
        runs = [at[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]
        marked = np.zeros(len(values), np.int32)
        left, right = [], []
        for i in np.flatnonzero(block == low):
            # inside one block each pair is met from its first row; otherwise rows of the other block are asked
            open_ = (np.arange(len(label)) > i) if same else block != low
            others = np.flatnonzero(open_ & (label != label[i]) & _like(size, size[i], similarity))
            others = others[np.bitwise_count(sketch[others] ^ sketch[i]).sum(1) <= limit]
            others = others[size[others] > 0]
            if not len(others):
                continue
            marked[runs[i]] = 1
            starts = np.concatenate(([0], np.cumsum(size[others])[:-1]))
            both = np.add.reduceat(marked[np.concatenate([runs[j] for j in others])], starts)
            marked[runs[i]] = 0
            linked = others[both >= similarity * (size[i] + size[others] - both) - 1e-9]
            left.append(np.full(len(linked), label[i]))
            right.append(label[linked])
        if not left:
            return pa.table({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
        left, right = np.concatenate(left), np.concatenate(right)
        names, ends_of = np.unique(np.concatenate((left, right)), return_inverse=True)
        root = local_roots(len(names), ends_of[: len(left)], ends_of[len(left) :])
        far = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"u": names[far], "v": names[root[far]]})

    return count


def _units(members: DataFrame) -> DataFrame:
    """members (key, node, label, size, sketch) of the buckets that hold several labels, once for each pair of blocks to be met.

    The label with the most nodes of a bucket needs no comparison with itself, so its blocks meet those of the others
    only. A block holds BLOCK nodes and BLOCK_SHINGLES shingles on average. Blocks are numbered, the others' first.
    """
    parts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    split = parts.groupBy("key").agg(F.max(F.struct("n", "s", "label")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > most.n")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("long")
    # staged, so that the join's sides are plain shuffles and the rows of a hot key can be split
    cut = stage(split.select("key", F.col("most.label").alias("major"), blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("few"), blocks(F.col("most.n"), F.col("most.s")).alias("many")), "cuts")
    rare, mixed = F.col("label") != F.col("major"), F.xxhash64("node")
    own = F.when(rare, F.pmod(mixed, F.col("few"))).otherwise(F.col("few") + F.pmod(mixed, F.col("many")))
    placed = members.join(cut, "key").withColumn("block", own)
    last = F.when(rare, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    units = stage(met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "size", "sketch"), "units")
    release(cut)
    return units


def exact_links(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root): components of the pairs that share a bucket (key, node, n rows) and have the similarity.

    A pair is left untested only if the sizes of its sets or its sketches rule it out or its nodes are already connected.
    All pairs of small buckets and the nearest ones of each node in large buckets are counted first, text against text.
    What these do not connect is counted block against block, on sets of shingles made once for each node. A large bucket
    of texts that are alike, but no copies, costs the square of their number there, as each pair must be looked at.
    """
    limit = sketch_limit(similarity)
    sketches = nodes.select("node", "sketch", "size")
    groups = buckets.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    paired = groups.select(F.posexplode("nodes").alias("at", "u"), "nodes").select("u", F.explode(F.slice("nodes", F.col("at") + 2, F.lit(SMALL))).alias("v")).distinct()
    far = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    close = paired.join(sketches.toDF("u", "x", "m"), "u").join(sketches.toDF("v", "y", "n"), "v").where((F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9) & (far <= limit)).select("u", "v")
    large = stage(buckets.where(F.col("n") > SMALL).join(sketches, "node"), "large-buckets")
    hubs = large.where(F.col("n") > BLOCK).groupBy("key").agg(F.min(F.struct("node", "n", "sketch", "size")).alias("hub"))
    block = lambda n: F.ceil(n / BLOCK).cast("long")
    rows = large.select("key", "node", "sketch", "size", F.pmod(F.xxhash64("node"), block(F.col("n"))).alias("block"))
    # the hub joins the blocks of its bucket
    hub = hubs.select("key", F.col("hub.node").alias("node"), F.col("hub.sketch").alias("sketch"), F.col("hub.size").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("hub.n")) - 1)).alias("block"))
    listed = rows.union(hub).groupBy("key", "block").applyInArrow(_nearest(limit, similarity), "u long, v long")
    pairs = stage(listed.union(close).distinct(), "near-pairs")
    found = _verified(pairs, nodes, docs, words, similarity)
    roots = components(found)
    labelled = large.join(roots, "node", "left").select("key", "node", "sketch", "size", F.coalesce("root", "node").alias("label"))
    met = _units(labelled)
    sets = _sets(met.select("node").distinct(), nodes, docs, words)
    more = met.join(sets, "node").groupBy("key", "low", "high").applyInArrow(_counted(limit, similarity), "u long, v long")
    # what was connected before is one star each
    joined = components(more.union(roots.where("node <> root").select("node", "root")))
    release(large, pairs, found, met, sets)
    return joined


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each group the document with the smallest doc_id stays.

    A link is a Jaccard similarity of at least `similarity` between the sets of distinct `words`-word shingles; groups
    are the components of the links. Fingerprints of five-word shingles differ in 4 to 14 of 64 bits at a similarity of
    0.8 to 0.9, too many for a trie. Candidates are therefore the fingerprints of shorter shingles, within 11 bits and
    four rotations of the trie, and the documents that share a band of minima. Every candidate link is then counted on
    the two sets. Rows equal in doc_id and text are one document. A document without doc_id stays only in a group in
    which none has one.
    """
    prints = stage(sketched(docs, words), "sketches")
    # the smallest id first; null ids last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk"))
    same = [F.first(c).alias(c) for c in ("size", "fp", "sketch", "bands")]
    nodes = stage(prints.groupBy("a", "b").agg(first.alias("first"), *same).withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    links = stage(near_links(nodes.select("node", "fp", "sketch"), CANDIDATE_BITS, ROTATIONS, sketch_limit(similarity), floor=2), "near-links")
    trie = links.select("v", "u").union(links.select("v", "v")).distinct().select(F.xxhash64(F.lit("trie"), "v").alias("key"), F.col("u").alias("node"))
    members = nodes.select(F.explode("bands").alias("key"), "node").union(trie)
    # staged for the same reason as the cuts of _units
    sizes = stage(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    buckets = stage(members.join(sizes, "key"), "buckets")
    roots = exact_links(buckets, nodes, docs, words, similarity)
    stays = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.rk").alias("__rk"))
    this = lambda i, k: F.col(i).eqNullSafe(F.col("__id")) & (F.col(k) == F.col("__rk"))
    goes = stage(prints.select("doc_id", "rk").distinct().join(stays, this("doc_id", "rk"), "left_anti").toDF("__id", "__rk"), "copies")
    release(prints, nodes, links, sizes, buckets)
    # only rows that may be copies are shuffled
    held = bloom.may_hold(goes.select(F.xxhash64("__id", "__rk").alias("h")))
    told = docs.withColumn("__key", F.xxhash64("text")).withColumn("__own", F.col("doc_id").cast("long")).withColumn("__may", held(F.xxhash64("__own", "__key")))
    apart = told.where("__may").join(goes, this("__own", "__key"), "left_anti")
    return told.where("NOT __may").unionByName(apart).select(*[F.col(c) for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = stage(fingerprints(docs, 3).select("doc_id", "fp"), "doc-fingerprints")
    return simhash_components(prints, 2).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
