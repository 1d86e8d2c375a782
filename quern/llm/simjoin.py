"""N-gram Jaccard join by chosen paths.

Every text is the set of its five-word shingles. Texts of one set are one representative, so copies cost nothing more.
In each run a representative follows every token whose random number, drawn from run and token, is below BRANCH / (threshold * size):
sets with the wanted similarity share a chosen token with high probability. Nodes with one representative end. In each other node all are
compared with one of its largest known class, on minhash sketches, and those alike join that class: a large group takes as many links as it has
rows. Pairs within a class could only tie what is tied. So a node of one class ends, whatever its size; in one of a class and at
most BLOCK others these are compared with all, by brute force, so work there grows with the node's rows. The rest are split again, on tokens sampled from the set by minhash, up
to DEPTH times; what then still is left is compared in blocks. Links tie classes, not rows.

Sketch matches well below the threshold (further below for small sets) give candidate classes (connected components). After every RUNS
runs the recall is measured: QUERIES representatives, drawn by hash, are compared with all by brute force on sketches, what these find
on whole sets, and runs go on, each with random numbers of its own, until TARGET of the pairs found so lie in one candidate class.
Within the classes every pair is checked exactly, in blocks, on the whole sets: this gives each text its number of links and the final classes.

Defined cases: a null text or one without words has the empty set, and all such texts are one class; a text of fewer than five words is
one shingle; a very long text is one set, whatever its size, and blocks hold fewer of such; similarity 1 links texts that differ in white
space only; sets at exactly the threshold are linked; rows that repeat a doc_id count as documents of their own; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.components import components, stars

WORDS, THRESHOLD = 5, 0.8
#: P(no shared chosen token in a run) is about exp(-BRANCH) at the threshold.
RUNS, BRANCH, TARGET, QUERIES = 4, 1.8, 0.995, 256
SKETCH, SMALL, DEPTH, BLOCK = 128, 64, 3, 1024
#: Elements of sets, at most, of one exact block, unless a single set is larger.
BLOCK_ITEMS = 400_000
#: Bytes of text hashed at a time.
STEP_BYTES = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def loose(n: np.ndarray) -> np.ndarray:
    """Three and a half deviations of sketch matches below the threshold, for sets of n tokens."""
    return THRESHOLD - 3.5 * np.sqrt(THRESHOLD * (1 - THRESHOLD) / np.clip(n, 8, SKETCH))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of _BASE and of its inverse modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + STEP_BYTES // 4
            both = []
            for x in (_BASE, pow(_BASE, -1, 1 << 64)):
                step = np.full(size, x, np.uint64)
                step[0] = 1
                with np.errstate(over="ignore"):
                    both.append(np.cumprod(step))
            self.up, self.down = both
        return self.up, self.down


_POWERS = _Powers()


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles. All texts are hashed together: a word's hash is a difference
    of running sums over the bytes, a shingle's one of its words in turn."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        words = _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * _M)
        first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))
        last = np.append(first[1:], len(words))
        rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            rolled = rolled * _M + words[k : k + len(rolled)]
        rolled = _mix(rolled)
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                h = np.zeros(1, np.uint64)
                for k in range(a, b):
                    h = h * _M + words[k : k + 1]
                out.append(_mix(h + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


_TRIES = np.stack([_mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(b << 20)) % np.uint64(SKETCH) for b in range(SKETCH)]).astype(np.int64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """SKETCH one-byte minhashes, by one permutation cut into SKETCH bins. An empty bin asks others, in an order of its own, for
    the first that is full."""
    h = _mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    bins = (h >> np.uint64(57)).astype(np.int64)
    none = np.iinfo(np.uint64).max
    low = np.full(SKETCH, none, np.uint64)
    np.minimum.at(low, bins, h & np.uint64((1 << 57) - 1))
    full = low != none
    empty = np.flatnonzero(~full)
    if len(empty):
        asked = full[_TRIES[empty]]
        hit = asked.argmax(axis=1)
        found = _TRIES[empty, hit]
        low[empty] = low[np.where(asked[np.arange(len(empty)), hit], found, int(np.flatnonzero(full)[0]))]
    return (_mix(low) & np.uint64(255)).astype(np.uint8)


def chosen(tokens: np.ndarray, first: int, runs: int) -> np.ndarray:
    """The nodes that a set of 32-bit tokens follows from the root in the runs from first on."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    limit = BRANCH / (THRESHOLD * len(tokens))
    wide, out = _mix(tokens.astype(np.uint64) + _M), []
    with np.errstate(over="ignore"):
        for run in range(first, first + runs):
            odd = _mix(np.array([run + 1], np.uint64)) | np.uint64(1)
            h = _mix(wide * odd)
            h = h if limit >= 1 else h[h < np.uint64(int(limit * 2.0**64))]
            out.append(_mix(h ^ odd))
    return np.concatenate(out).astype(np.int64)


def _rid(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _steps(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Shingles of texts, from a position on, some STEP_BYTES at a time."""
    raw, begin, size = [(t or "").encode("utf-8", "surrogatepass") for t in texts], 0, 0
    for i, x in enumerate(raw):
        size += len(x)
        if size >= STEP_BYTES or i == len(raw) - 1:
            yield begin, shingles(raw[begin : i + 1])
            begin, size = i + 1, 0


def represent(docs: DataFrame) -> DataFrame:
    """doc_id, rid (of the shingle set), n (its size), tokens (the set's 32-bit hashes, sorted), sketch, nodes of the first runs, key
    (of the text itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            ids, keys = b.column(0).to_pylist(), b.column(2).to_pylist()
            for at, sets in _steps(b.column(1).to_pylist()):
                rows = []
                for doc_id, key, t in zip(ids[at : at + len(sets)], keys[at : at + len(sets)], sets, strict=True):
                    short = (t >> np.uint64(32)).astype("<u4")
                    short = short[np.append(True, short[1:] != short[:-1])] if len(short) else short
                    rows.append((doc_id, _rid(t), len(short), short.tobytes(), sketch(t).tobytes() if len(t) else b"", chosen(short, 0, RUNS), key))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "rid", "n", "tokens", "sketch", "nodes", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).mapInArrow(common.tidied(run), "doc_id long, rid long, n int, tokens binary, sketch binary, nodes array<long>, key long")


def further_nodes(rows: DataFrame, first: int) -> DataFrame:
    """rid, nodes: those of the RUNS runs from first on, from the tokens of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [chosen(np.frombuffer(t, "<u4"), first, RUNS) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.list_(pa.int64()))], names=["rid", "nodes"])

    return rows.select("rid", "tokens").mapInArrow(common.tidied(run), "rid long, nodes array<long>")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of a partition sorted by key, cut so that no group is divided; groups here are bounded by their makers."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left")) if k[0] != k[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _lowest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of components: the least position that a chain of links i-j leads to."""
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare_first(rows: DataFrame) -> DataFrame:
    """node, size, rid, n, sketch, cls, tied, main of rows(..., first_cls, first_n, first_sketch): a row alike the first of its node takes
    over the class of that, main, and tied is its own class before, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, cls, first_cls, first_n = (b.column(k).to_numpy() for k in (3, 5, 6, 7))
                s, first = (_bytes(pa.chunked_array([b.column(k)]), SKETCH) for k in (4, 8))
                alike = (cls == first_cls) | ((s == first).mean(axis=1) >= np.minimum(loose(n), loose(first_n)))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(np.where(alike, first_cls, cls)), pa.array(cls, mask=~alike | (cls == first_cls)), b.column(6)], names=["node", "size", "rid", "n", "sketch", "cls", "tied", "main"])

    return rows.select("node", "size", "rid", "n", "sketch", "cls", "first_cls", "first_n", "first_sketch").mapInArrow(common.tidied(run), "node long, size long, rid long, n int, sketch binary, cls long, tied long, main long")


def _ties(cls: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """a, b: the classes that labels tie together."""
    pairs = np.stack([cls, cls[label]], axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])


def _within_small(node: np.ndarray, s: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows alike in one node, for rows sorted by node, all nodes at a time."""
    left, right, d = [], [], 1
    while d < len(node):
        i = np.flatnonzero(node[:-d] == node[d:])
        if not len(i):
            break
        alike = np.concatenate([(s[x] == s[x + d]).mean(axis=1) for x in np.array_split(i, len(i) // 50_000 + 1)])
        hit = i[alike >= np.minimum(least[i], least[i + d])]
        left.append(hit)
        right.append(hit + d)
        d += 1
    i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    return i, j


def _descend(rows: DataFrame, depth: int) -> DataFrame:
    """node, rid, cls, n, sketch of the children that each row of a large node follows, on tokens (position, value) of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.uint64(int(2.0**64 * BRANCH / (THRESHOLD * SKETCH)))
        place = np.arange(SKETCH, dtype=np.uint64) << np.uint64(8)
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                t = pa.Table.from_batches([b.slice(k, 2048)])
                node, s = t.column("node").to_numpy().astype(np.uint64), _bytes(t.column("sketch"), SKETCH)
                with np.errstate(over="ignore"):
                    h = _mix(_mix(node + np.uint64(depth * int(_M) % 2**64))[:, None] ^ (place + s).astype(np.uint64) * _M)
                i, j = np.nonzero(h < limit)
                yield pa.RecordBatch.from_arrays([pa.array(h[i, j].astype(np.int64)), *[t.column(c).take(pa.array(i)).combine_chunks() for c in ("rid", "cls", "n", "sketch")]], names=["node", "rid", "cls", "n", "sketch"])

    return rows.select("node", "rid", "cls", "n", "sketch").mapInArrow(common.tidied(run), "node long, rid long, cls long, n int, sketch binary")


def _blocked(rows: DataFrame, key: str, sizes: DataFrame, block: int) -> DataFrame:
    """rows with part (of a pair of blocks of their group) and side (0, 1; both sides are one block where they are equal).

    A group of g rows is dealt into g / block blocks by a hash, and each block meets each other once: a row goes to as many
    tasks as there are blocks, and no task gets more than two.
    """
    r = rows.join(sizes.select(key, F.ceil(F.col("size") / block).cast("int").alias("blocks")), key)
    mine = F.pmod(F.xxhash64("rid", F.lit("block")), F.col("blocks")).cast("int")
    r = r.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    return r.withColumn("part", F.xxhash64(key, lo, hi)).withColumn("side", (F.col("mine") > F.col("other")).cast("int")).withColumn("same", F.col("mine") == F.col("other")).drop("mine", "other", "blocks")


def _compare_rest(rows: DataFrame) -> DataFrame:
    """a, b: links that tie together the classes in which brute force finds rows alike in each node of rows(node, size, main, rid, cls, n, sketch), of
    which at most BLOCK are not of the class main: these go to each block of their node, the others to one, and only pairs with one of these are
    compared. Nodes of at most SMALL rows are one block, all of whose pairs are compared. Both kinds share a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "part"):
            few = t.column("few").to_numpy()
            part, cls, main = (t.column(c).to_numpy() for c in ("part", "cls", "main"))
            s, least = _bytes(t.column("sketch"), SKETCH), loose(t.column("n").to_numpy())
            if few.any():
                yield _ties(cls[few], _lowest(np.arange(np.count_nonzero(few)), *_within_small(part[few], s[few], least[few])))
            part, cls, main, s, least = (x[~few] for x in (part, cls, main, s, least))
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                left, right = [np.zeros(0, int)], [np.zeros(0, int)]
                for i in np.flatnonzero(cls[x:y] != main[x:y]):
                    hit = np.flatnonzero(np.count_nonzero(s[x:y] == s[x + i], axis=1) / SKETCH >= np.minimum(least[x + i], least[x:y]))
                    left.append(np.full(len(hit), i))
                    right.append(hit)
                yield _ties(cls[x:y], _lowest(np.arange(y - x), np.concatenate(left), np.concatenate(right)))

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.when(F.col("cls") == F.col("main"), F.array(F.pmod(F.xxhash64("rid", F.lit("block")), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
    rows = rows.withColumns({"block": F.explode(block), "few": F.col("size") <= SMALL}).withColumn("part", F.xxhash64("node", "block")).select("part", "few", "cls", "main", "n", "sketch")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(common.tidied(_as_stars(run)), "a long, b long")


def _as_stars(run):
    """run, whose links (a, b) become stars before they leave the task."""
    return lambda batches: stars(run(batches), ("a", "b"))


def _compare_blocks(rows: DataFrame) -> DataFrame:
    """a, b: like _compare_rest, for rows(part, side, cls, n, sketch) of pairs of blocks, all of whose pairs are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "part"):
            part = t.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            cls, s, least = t.column("cls").to_numpy(), _bytes(t.column("sketch"), SKETCH), loose(t.column("n").to_numpy())
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                sk, left, right = s[x:y], [], []
                for i in range(len(sk) - 1):
                    hit = np.flatnonzero((sk[i + 1 :] == sk[i]).mean(axis=1) >= np.minimum(least[x + i], least[x + i + 1 : y])) + i + 1
                    left.append(np.full(len(hit), i))
                    right.append(hit)
                if left:
                    yield _ties(cls[x:y], _lowest(np.arange(len(sk)), np.concatenate(left), np.concatenate(right)))

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(common.tidied(_as_stars(run)), "a long, b long")


def candidates(reps: DataFrame, nodes: DataFrame, group: DataFrame | None = None) -> DataFrame:
    """node, root: the candidate classes of reps(rid, n, sketch), as sketches see them in the runs of nodes(rid, nodes), one row a rid, on top of
    those that group(node, root) holds. nodes may be reps itself."""
    rows = nodes.select("rid", *[c for c in ("n", "sketch") if c in nodes.columns], F.explode(F.array_distinct("nodes")).alias("node"))
    rows = rows.withColumn("cls", F.col("rid")) if group is None else rows.join(common.small(common.renamed(group, {"node": "rid"})), "rid", "left").withColumn("cls", F.coalesce("root", "rid")).drop("root")
    found = None if group is None else group.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for depth in range(DEPTH + 1):
        per = rows.groupBy("node", "cls").agg(F.count("*").alias("c"), F.min("rid").alias("first")).groupBy("node") if depth or group is not None else rows.withColumns({"c": F.lit(1), "first": F.col("rid")}).groupBy("node")
        per = per.agg(F.sum("c").alias("size"), F.count("*").alias("kinds"), F.max(F.struct("c", "first", "cls")).alias("k")).filter("kinds > 1")
        per = common.settle(per.select("node", "size", F.col("k.first").alias("first"), F.col("k.cls").alias("first_cls")), "join-shared")
        if not depth and not ("sketch" in rows.columns and common.fits(per)):
            # Sketches are not shuffled with rows that go: they are fetched for those that stay.
            rows = rows.drop("n", "sketch").join(common.small(per), "node").join(reps.select("rid", "n", "sketch"), "rid")
        else:
            rows = rows.join(common.small(per), "node")
        shared = rows = common.settle(rows, "join-shared")
        # Each node's first is one of its rows: sketches are not fetched from reps again.
        first = rows.filter(F.col("rid") == F.col("first")).select("node", F.col("n").alias("first_n"), F.col("sketch").alias("first_sketch"))
        first = common.settle(first, "join-firsts")
        rows = common.settle(_compare_first(rows.join(common.small(first), "node")), "join-nodes")
        common.release(shared)
        ties = rows.filter("tied is not null").select(F.col("tied").alias("a"), F.col("cls").alias("b")).mapInArrow(common.tidied(_as_stars(iter)), "a long, b long")
        found = ties if found is None else found.unionByName(ties)
        if depth == 1:
            # What lies in one class by other nodes, too, needs no comparison in the nodes that are split further.
            known = components(common.settle(found, "join-links"))
            found = known.select(F.col("node").alias("a"), F.col("root").alias("b"))
            rows = rows.join(common.small(common.renamed(known, {"node": "rid"})), "rid", "left").withColumn("cls", F.coalesce("root", "cls")).drop("root")
            # The largest class of a node may be another now.
            per = rows.groupBy("node", "cls").agg(F.count("*").alias("c")).groupBy("node").agg(F.sum("c").alias("all"), F.max(F.struct("c", "cls")).alias("k")).select("node", F.col("k.cls").alias("main"), (F.col("all") - F.col("k.c")).alias("others"))
        else:
            per = rows.groupBy("node", "main").agg(F.count_if(F.col("cls") != F.col("main")).alias("others"))
        # Nodes of several classes still, with the largest of them and what is not in it.
        still = common.settle(per.filter("others > 0"), "join-open", large=F.count_if(F.col("others") > BLOCK))
        rows = rows.drop("tied", "main").join(common.small(still), "node")
        found = found.unionByName(_compare_rest(rows.filter((F.col("size") <= SMALL) | (F.col("others") <= BLOCK))))
        if not still._watched["large"]:
            break
        large = rows.filter((F.col("size") > SMALL) & (F.col("others") > BLOCK))
        if depth < DEPTH:
            rows = common.settle(_descend(large, depth + 1), "join-nodes")
        else:
            found = found.unionByName(_compare_blocks(_blocked(large.select("node", "rid", "cls", "n", "sketch"), "node", large.select("node", "size").distinct(), BLOCK)))
    return components(common.settle(found, "join-links"))


def recall(reps: DataFrame, rows: DataFrame, group: DataFrame) -> float:
    """The share of pairs alike that lie in one class of group(node, root): QUERIES of reps(rid, n, sketch), drawn by hash, against
    all others by brute force on the sketches; what these find is checked on the tokens of rows(rid, tokens), as sketches of few
    tokens may agree where no token does, which no run would ever tie. 1 if there is no such pair."""
    classed = reps.join(common.small(group), F.col("rid") == F.col("node"), "left").select("rid", "n", "sketch", F.coalesce("root", "rid").alias("root"))
    drawn = reps.orderBy(F.xxhash64(F.lit("query"), "rid")).limit(QUERIES).select("rid")
    asked = classed.join(F.broadcast(drawn), "rid").collect()
    q = np.frombuffer(b"".join(bytes(r["sketch"]) for r in asked), np.uint8).reshape(-1, SKETCH)
    ids, roots, least = np.array([r["rid"] for r in asked], np.int64), np.array([r["root"] for r in asked], np.int64), loose(np.array([r["n"] for r in asked]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rid, root, limit = b.column(0).to_numpy(), b.column(3).to_numpy(), loose(b.column(1).to_numpy())
            s, found = _bytes(pa.chunked_array([b.column(2)]), SKETCH), []
            for i in range(len(ids)):
                hit = np.flatnonzero(((s == q[i]).mean(axis=1) >= np.minimum(limit, least[i])) & (rid != ids[i]))
                if len(hit):
                    found.append((np.full(len(hit), ids[i]), rid[hit], root[hit] == roots[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query", "other", "together"])

    pairs = common.settle(classed.mapInArrow(common.tidied(near), "query long, other long, together boolean"), "join-asked")
    own = rows.join(F.broadcast(drawn), "rid").groupBy("rid").agg(F.first("tokens").alias("tokens")).collect()
    sets = {r["rid"]: np.frombuffer(bytes(r["tokens"]), "<u4") for r in own}

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, (query, tokens) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)):
                x, y = sets[query], np.frombuffer(tokens, "<u4")
                if min(len(x), len(y)) >= THRESHOLD * max(len(x), len(y)):
                    o = len(np.intersect1d(x, y, assume_unique=True))
                    if (1 + THRESHOLD) * o + 1e-3 >= THRESHOLD * (len(x) + len(y)):
                        keep.append(k)
            yield b.select(["query", "other", "together"]).take(pa.array(keep, pa.int64()))

    held = rows.select("rid", "tokens").join(common.small(pairs), F.col("rid") == F.col("other")).select("query", "other", "together", "tokens")
    alike = held.mapInArrow(common.tidied(check), "query long, other long, together boolean").distinct()
    got = alike.agg(F.count("*").alias("t"), F.count_if("together").alias("g")).first()
    return got["g"] / got["t"] if got["t"] else 1.0


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of left with right sets, from tokens that both sides hold, some thousand tokens at a time."""
    both = []
    for sets in (left, right):
        both.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)))
    shared = np.intersect1d(both[0][1], both[1][1]) if left is not right else np.unique(both[0][1])
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for owner, token in both:
        at = np.searchsorted(shared, token)
        keep = at < len(shared)
        keep[keep] = shared[at[keep]] == token[keep]
        owner, at = owner[keep], at[keep]
        order = np.argsort(at, kind="stable")
        sides.append((owner[order], at[order]))
    for lo in range(0, len(shared), 4096):
        m = []
        for (owner, at), n in zip(sides, out.shape, strict=True):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            x = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
            x[owner[a:b], at[a:b] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _verify(rows: DataFrame) -> DataFrame:
    """rid, root, links: for rows(part, side, same, rid, copies, tokens), each row's linked documents in the part, and the least row it is tied to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "part"):
            part = t.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            rid, side, same, copies = (t.column(c).to_numpy() for c in ("rid", "side", "same", "copies"))
            out = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                sets = [np.frombuffer(v, "<u4") for v in t.column("tokens").slice(x, y - x).to_pylist()]
                # A block meets itself or another; pairs within a block are counted where it meets itself.
                left, right = (np.arange(y - x),) * 2 if same[x] else (np.flatnonzero(side[x:y] == k) for k in (0, 1))
                links = np.zeros(y - x)
                i = j = np.zeros(0, int)
                if len(left) and len(right):
                    mine = [sets[k] for k in left]
                    n = np.array([len(v) for v in sets], np.float32)
                    o = _overlaps(mine, mine if same[x] else [sets[k] for k in right])
                    # 1e-3: far above what float32 rounds here, far below the least step of the two sides, 0.2.
                    alike = (1 + THRESHOLD) * o + 1e-3 >= THRESHOLD * (n[left][:, None] + n[right][None, :])
                    if same[x]:
                        np.fill_diagonal(alike, False)
                    weight = copies[x:y].astype(np.float64)
                    links[left] += alike @ weight[right]
                    if not same[x]:
                        links[right] += weight[left] @ alike
                    i, j = np.nonzero(alike)
                    i, j = left[i], right[j]
                label = _lowest(np.arange(y - x), i, j)
                out.append((rid[x:y], rid[x:y][label], links))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int64))], names=["rid", "root", "links"])

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(common.tidied(run), "rid long, root long, links long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each row of docs(doc_id, text): doc_id, rid, key (xxhash64 of the text); and for each set: rid, least (its least doc_id, null if all are), root
    (one rid of its class), n_links."""
    rows = common.settle(represent(docs), "join-rows")
    # Rows of one rid agree in all but doc_id, so it doesn't matter which is taken.
    sets = rows.groupBy("rid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "sketch", "nodes")])
    sets = common.settle(sets, "join-reps")
    copies, reps = sets.select("rid", "copies", "least", "n"), sets.filter("n > 0").select("rid", "n", "sketch", "nodes")
    found, run, nodes = None, 0, reps
    while True:
        found = candidates(reps, nodes, found)
        if recall(reps, rows, found) >= TARGET:
            break
        run += RUNS
        nodes = further_nodes(rows.filter("n > 0"), run).groupBy("rid").agg(F.first("nodes").alias("nodes"))
        nodes = common.settle(nodes, "join-further")
    group = common.settle(copies.join(common.small(common.renamed(found, {"node": "rid"})), "rid").select("rid", "root", "copies", "n"), "join-groups")
    sizes = group.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("items"))
    sizes = sizes.select("root", F.greatest(F.col("rows"), F.ceil(F.col("items") * BLOCK / BLOCK_ITEMS)).alias("size"))
    # Only sets that have a candidate are moved, and copies are dropped before it.
    member = rows.select("rid", "tokens").join(common.small(group.select("rid", "root", "copies"), of=group), "rid").groupBy("rid").agg(*[F.first(c).alias(c) for c in ("root", "copies", "tokens")])
    checked = common.settle(_verify(_blocked(member, "root", sizes, BLOCK)), "join-checked")
    links = checked.groupBy("rid").agg(F.sum("links").alias("links"))
    final = components(checked.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    c = copies.join(links, "rid", "left").join(common.small(common.renamed(final, {"node": "rid"})), "rid", "left")
    c = common.settle(c.select("rid", F.coalesce("root", "rid").alias("root"), "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "join-classes")
    return rows.select("doc_id", "rid", "key"), c


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_links (documents at THRESHOLD or more) for each row of docs(doc_id, text)."""
    rows, c = classes(docs)
    ids = c.groupBy("root").agg(F.min("least").alias("class_id"))
    c = c.join(ids, "root").select("rid", "class_id", "n_links")
    return rows.join(c, "rid").select("doc_id", "class_id", "n_links")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir))
