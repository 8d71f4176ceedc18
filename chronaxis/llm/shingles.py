"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

A document is the set of its distinct word n-grams.  Equal sets are one node.
Only nodes that share some of their smallest n-gram hashes with other nodes can
have a partner, and only if they share enough of them (prefix filter); their
hashed bitmaps meet in tiles.  A tile
pairs two blocks of nodes of nearby sizes, and the bit counts of the XOR bound
the overlap from above.  Pairs that pass are intersected exactly as sorted
arrays.  Nodes already connected need no further pair, so a group of near
copies costs about one pair per node instead of all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, persisted
from .components import components

MUL = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
BLOCK = 1 << 20
WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (splitmix finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64, for i < n."""
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = BASE, pow(BASE, -1, 1 << 64)
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte string, A-Z lower-cased."""
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    size = BLOCK if len(data) <= BLOCK else 1 << (len(data) - 1).bit_length()
    up, down = powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MUL), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Cut a long byte string at white space into pieces of about BLOCK bytes."""
    at = 0
    while len(raw) - at > BLOCK:
        end = max(raw.rfind(b, at, at + BLOCK) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if end <= at:
            end = min((e for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (e := raw.find(b, at + BLOCK)) >= 0), default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of fewer words, the whole sequence as one."""
    k = min(n, len(words))
    out = np.full(max(len(words) - k + 1, 0) if k else 0, k, np.uint64)
    for i in range(k):
        out = out * MUL + words[i:len(words) - k + 1 + i]
    return mix(out)


def shingle_sets(texts: list[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of every text, in order."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if not group:
            return
        starts = np.cumsum([0] + [len(g) + 1 for g in group])
        words, at = word_hashes(b"\n".join(group))
        cut = np.searchsorted(at, starts)
        for i in range(len(group)):
            yield np.unique(_grams(words[cut[i]:cut[i + 1]], n))
        group.clear()

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > BLOCK // 2:
            yield from flush()
            size = 0
            yield np.unique(_grams(np.concatenate([word_hashes(p)[0] for p in _pieces(raw)]), n))
            continue
        if size + len(raw) + 1 > BLOCK:
            yield from flush()
            size = 0
        group.append(raw)
        size += len(raw) + 1
    yield from flush()


def set_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(grams: np.ndarray) -> bytes:
    """Parity of the hashes per slot; a power of two of slots, at least one per element."""
    slots = max(64, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def spare(size: int, percent: int) -> int:
    return size * (100 - percent) // 200


def prefix_length(size: int, percent: int) -> int:
    """Two sets at the threshold share at least 1 + the smaller :func:`spare` of so many smallest elements."""
    return size - -(-percent * size // 100) + 1 + spare(size, percent)


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("bits", pa.binary())])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        rows = [(len(g), set_id(g), bitmap(g)) if len(g) else (0, 0, None) for g in shingle_sets(texts)]
        n, sid, bits = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary())], schema=SETS)


def _keys(buckets: int, percent: int):
    """Prefix hashes by bucket, each once per task part, and how many of its hashes each node already shares here."""
    def cut(keys: list[np.ndarray], sids: list[np.ndarray]) -> pa.RecordBatch:
        k, s = np.concatenate(keys), np.concatenate(sids)
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        first = np.r_[True, k[1:] != k[:-1]]
        run = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        several = np.minimum.reduceat(s, starts) < np.maximum.reduceat(s, starts)
        fresh = first | np.r_[True, s[1:] != s[:-1]]
        met, times = np.unique(s[several[run] & fresh], return_counts=True)
        k, s = k[starts], s[starts]
        home = (k >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(home, kind="stable")
        k, s, several = k[order], s[order], several[order]
        ends = np.searchsorted(home[order], np.arange(buckets + 1))
        rows = {c: [] for c in KEYS.names}
        for b in range(buckets):
            at, mine = slice(ends[b], ends[b + 1]), slice(b, None, buckets)
            if at.start < at.stop or b < len(met):
                rows["bucket"].append(b)
                rows["keys"].append(k[at].tobytes())
                rows["sids"].append(s[at].tobytes())
                rows["several"].append(several[at].tobytes())
                rows["met"].append(met[mine].tobytes())
                rows["times"].append(times[mine].astype("<i8").tobytes())
        return pa.RecordBatch.from_pydict(rows, schema=KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sids, held = [], [], 0
        for batch in batches:
            for g in shingle_sets(batch.column("text").to_pylist()):
                if len(g):
                    k = g[:prefix_length(len(g), percent)]
                    keys.append(k)
                    sids.append(np.full(len(k), set_id(g), np.int64))
                    held += len(k)
                    if held > 1 << 21:
                        yield cut(keys, sids)
                        keys, sids, held = [], [], 0
        if held:
            yield cut(keys, sids)
    return run


KEYS = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("keys", "sids", "several", "met", "times")])
KEYS_DDL = "bucket int, keys binary, sids binary, several binary, met binary, times binary"


def _shared(table: pa.Table) -> pa.Table:
    """How many keys of one bucket each node shares with another node."""
    def column(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    keys, sids, several = column("keys", "<u8"), column("sids", "<i8"), column("several", "?")
    order = np.argsort(keys, kind="stable")
    keys, sids, several = keys[order], sids[order], several[order]
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    more = sids[:0]
    if len(starts):
        run = np.cumsum(first) - 1
        common = (np.minimum.reduceat(sids, starts) < np.maximum.reduceat(sids, starts)) | np.logical_or.reduceat(several, starts)
        more = sids[common[run] & ~several]  # the others were counted where they met
    node = np.concatenate((column("met", "<i8"), more))
    times = np.concatenate((column("times", "<i8"), np.ones(len(more), np.int64)))
    sid, at = np.unique(node, return_inverse=True)
    return pa.table({"sid": pa.array(sid, pa.int64()), "times": pa.array(np.bincount(at, times, len(sid)).astype(np.int64))})


def _folded(rows: list[bytes], slots: int) -> np.ndarray:
    """Bitmaps as 64-bit words, folded to a common number of slots."""
    out = np.empty((len(rows), slots // 64), np.uint64)
    for i, raw in enumerate(rows):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, "<u8").reshape(-1, slots // 64), axis=0)
    return out


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bound", pa.float64()), ("kind", pa.int32())])


def _tile(percent: int, every: bool):
    """Pairs of one tile that the bit counts cannot exclude and whose nodes are not yet connected.

    With ``every`` all of them, otherwise for each node the partner with the
    smallest label and the one with the highest bound.
    """
    def run(table: pa.Table) -> pa.Table:
        n, sid, label = (table.column(c).to_numpy() for c in ("n", "sid", "label"))
        side = table.column("side").to_numpy(zero_copy_only=False)
        order = np.argsort(n, kind="stable")
        n, sid, label, side = n[order], sid[order], label[order], side[order]
        bits = table.column("bits").to_pylist()
        bits = [bits[i] for i in order]
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        same = bool(np.any(side == 1))  # a block against itself
        width = np.array([8 * len(b) for b in bits])
        out: dict[str, list] = {"a": [], "b": [], "bound": [], "kind": []}
        for wl in np.unique(width[left]):
            for wr in np.unique(width[right]):
                li, ri = left[width[left] == wl], right[width[right] == wr]
                slots = int(min(wl, wr))
                lb, rb = _folded([bits[i] for i in li], slots), _folded([bits[i] for i in ri], slots)
                for p, x in enumerate(li):
                    lo = np.searchsorted(n[ri], -(-percent * n[x] // 100))
                    hi = np.searchsorted(n[ri], 100 * n[x] // percent, side="right")
                    if lo >= hi:
                        continue
                    y = ri[lo:hi]
                    apart = np.bitwise_count(rb[lo:hi] ^ lb[p]).sum(axis=1, dtype=np.int64)
                    both = n[x] + n[y]
                    most = (both - apart) // 2
                    # 100 * overlap >= percent * union, with union = both - overlap
                    ok = ((100 + percent) * most >= percent * both) & (label[y] != label[x])
                    if same:
                        ok &= y != x if not every else y > x
                    hit = np.flatnonzero(ok)
                    if not len(hit):
                        continue
                    score = most[hit] / (both[hit] - most[hit])
                    if every:
                        take, kinds = np.arange(len(hit)), np.zeros(len(hit), np.int32)
                    else:
                        take, kinds = np.array([np.argmin(label[y[hit]]), np.argmax(score)]), np.array([0, 1], np.int32)
                    out["a"].extend([sid[x]] * len(take))
                    out["b"].extend(sid[y[hit[take]]].tolist())
                    out["bound"].extend(score[take].tolist())
                    out["kind"].extend(kinds.tolist())
        return pa.Table.from_pydict(out, schema=PAIR)
    return run


def candidate_pairs(nodes: DataFrame, percent: int, block_rows: int, every: bool) -> DataFrame:
    """Candidate pairs (a, b) of nodes (sid, n, bits, label) whose labels differ."""
    step = F.log(F.lit(100.0 / percent))
    # Sizes within the threshold's ratio are at most one band apart.
    nodes = nodes.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step + F.lit(1e-9)).cast("int"))
    counts = {r["band"]: -(-r["count"] // block_rows) for r in nodes.groupBy("band").count().collect()}  # bands grow with log of size
    if not counts:
        return nodes.select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    blocks = F.create_map(*[F.lit(x) for b, c in sorted(counts.items()) for x in (b, c)])

    def among(band):
        return F.coalesce(F.try_element_at(blocks, band), F.lit(0))

    def tiles(count, make):
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), make)).otherwise(F.array().cast("array<struct<tile:string,side:int>>"))

    band, block = F.col("band"), F.col("block")
    name = lambda *parts: F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    own = tiles(among(band), lambda j: F.struct(
        name("s", band, F.least(block, j), F.greatest(block, j)).alias("tile"),
        F.when(block == j, F.lit(1)).when(block < j, F.lit(0)).otherwise(F.lit(2)).alias("side")))
    up = tiles(among(band + 1), lambda j: F.struct(name("u", band, block, j).alias("tile"), F.lit(0).alias("side")))
    down = tiles(among(band - 1), lambda j: F.struct(name("u", band - 1, j, block).alias("tile"), F.lit(2).alias("side")))
    placed = nodes.withColumn("block", F.pmod(F.xxhash64("sid"), among(band)).cast("int"))
    placed = placed.select("sid", "n", "bits", "label", F.explode(F.concat(own, up, down)).alias("_t")).select("sid", "n", "bits", "label", "_t.tile", "_t.side")
    found = placed.groupBy("tile").applyInArrow(_tile(percent, every), "a long, b long, bound double, kind int")
    if not every:
        best = found.groupBy("a").agg(F.min(F.when(F.col("kind") == 0, F.col("b"))).alias("_low"), F.max_by("b", "bound").alias("_near"))
        found = best.select("a", F.explode(F.array("_low", "_near")).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


FILTER_BITS = 1 << 23


def _wanted_sets(words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(words, np.uint8), bitorder="little")
        for batch in batches:
            pos = batch.column("pos").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(bits[pos])
            texts = batch.column("text").take(pa.array(keep)).to_pylist()
            sets = [g for g in shingle_sets(texts) if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], ["sid", "grams"])
    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])
    return run


def verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets, rebuilt from whole texts, reach the threshold."""
    need = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int")
    # A fixed-size bitmap of wanted documents keeps other texts out of Python; the join below is exact.
    words = need.join(nodes.select("sid", "doc_id"), "sid").select(slot.alias("pos")).groupBy((F.col("pos") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toArrow()
    table[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    sets = documents.select("text", slot.alias("pos")).mapInArrow(_wanted_sets(table.astype("<i8").tobytes()), "sid long, grams binary")
    sets = persisted(sets.join(need, "sid", "left_semi").dropDuplicates(["sid"]), "shingle-sets")
    x, y = sets.select(F.col("sid").alias("a"), F.col("grams").alias("x")), sets.select(F.col("sid").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long")


def jaccard_components(documents: DataFrame, percent: int = 80, block_rows: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets
    of 5-word n-grams; component_id is the smallest doc_id reachable by links,
    itself included.  Null and wordless texts have an empty set and link with
    nothing.  Repeated rows are copies of each other.  A row without an id is
    linked like any other but never names a component, so a component of such
    rows alone has a null component_id.  Other columns are not carried.  Sets
    and n-grams are compared by 64-bit hashes.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    signed = persisted(docs.mapInArrow(_signatures, "doc_id long, n long, sid long, bits binary"), "signatures")
    full = signed.filter("n > 0")
    shared = docs.select("text").mapInArrow(_keys(4 * partitions(spark), percent), KEYS_DDL)
    shared = shared.groupBy("bucket").applyInArrow(_shared, "sid long, times long").groupBy("sid").agg(F.sum("times").alias("times"))
    nodes = full.groupBy("sid").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("bits").alias("bits"))
    # The least spare of any set that could be a partner.
    least = F.floor(F.ceil(F.col("n") * percent / 100) * (100 - percent) / 200)
    nodes = persisted(nodes.join(shared, "sid").filter(F.col("times") > least).drop("times"), "nodes")

    links, tested = None, None
    labels = nodes.withColumn("label", F.col("sid"))
    for every in (False, False, True):
        pairs = candidate_pairs(labels, percent, block_rows, every)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = persisted(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = persisted(verified(pairs, nodes, docs, percent), "links")
        links = found if links is None else links.unionByName(found)
        known = components(links)
        labels = nodes.join(known.withColumnRenamed("id", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))

    # Small table: one row per node that has a link.
    group = full.join(known.select(F.col("id").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    heads = group.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = group.select("doc_id", "n", "label").join(heads, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)
