"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

Two fingerprints that differ in at most ``t`` of the bits of ``m`` segments in a ring have a segment from which, for every length
``l``, the next ``l`` segments together differ in at most ``l * t / m`` bits. With four segments and three bits that is
one equal segment whose successor differs in at most one bit, so one half of the successor is equal too:
eight keys of 24 bits find every pair. The chain is then checked to its end, and last the whole distance.

A key shared by more than ``GROUP`` different fingerprints is split by the same principle on the bits that it leaves open (four parts,
one of them equal), three times, up to keys of 46 to 48 bits. What still shares such a key, however many, is compared in full in parts over
tasks. Equal fingerprints are one class throughout, and what leaves a group of a key is a spanning forest of its links. Components come from rounds of
joins that move each node to its smallest neighbour, until none moves.

For a Jaccard similarity of 0.8 a bit fingerprint needs a distance of up to 18 of 64, where keys of whole segments find little.
``similar_components`` therefore takes its candidates from fingerprints of 128 one-byte lanes (each the low byte of the least shingle hash
under a function of its own) in sixteen segments by the same chains; a key is four lanes' whole hashes. Lanes may differ by four standard errors
more than the similarity says, and a link is kept only where the exact similarity of the whole sets of shingle hashes is high enough.
A key or a group of candidates of any size is compared in full, in parts over tasks; only pairs that are connected already are left out.

Null and empty texts have fingerprint zero, or equal lanes, and are linked like any other. Texts shorter than a shingle are one shingle.
A node is a fingerprint, or for ``deduplicate`` a set of shingles, and never an id: rows with null ids link others without being anyone's representative, and rows
that repeat an id with different texts are linked by their texts alone. A component without any id has none. For ``deduplicate`` rows with null or repeated ids stay
unless their texts are similar. Empty tables give no rows. No column but the id and the text is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import few, release, slices, stored, tidy, whole_text

DISTANCE, SEGMENTS = 3, 4
GROUP = 1000
SEED = 42
LANES, KEYS = 128, 16
#: Nodes of a large group that go to each of its parts, and rows of a part where texts' whole hashes are compared.
COMMON, TEXTS = 4, 250
ALL = (1 << 64) - 1


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of so many words, in order, A-Z in lower case."""
    import xxhash

    parts = text.encode().lower().split()  # of bytes: at ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-words] + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_PLACE = np.arange(8) * 256


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(2048)
    for at in range(0, len(hashes), 1 << 18):
        octets = hashes[at : at + (1 << 18)].astype(">u8").view(np.uint8).reshape(-1, 8) + _PLACE
        counts += np.bincount(octets.ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", counts.reshape(8, 256), _BITS)
    return int.from_bytes(np.packbits((2 * ones > len(hashes)).ravel()).tobytes())


def _multipliers(lanes: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, lanes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lane_minima(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each lane the least of the hashes under its own function."""
    least = np.full(len(factors), ALL, np.uint64)
    hashes = np.unique(hashes)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * factors[None, :]).min(0), out=least)
    return least >> np.uint64(32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(tidy(work), "doc_id long, fp long")


def _parts(mask: int, parts: int) -> list[int]:
    """The bits that a mask leaves open, as so many masks."""
    free = [1 << b for b in range(64) if not mask >> b & 1]
    cut = np.linspace(0, len(free), parts + 1).astype(int)
    return [sum(free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def first_masks() -> list[int]:
    """A segment and one half of the next one."""
    seg, half = (1 << 16) - 1, (1 << 8) - 1
    return [seg << 16 * i | half << (16 * ((i + 1) % 4) + 8 * h) for i in range(SEGMENTS) for h in range(2)]


def deeper_masks(masks: list[int]) -> list[list[int]]:
    """For each mask those that it is split into."""
    return [[m | p for p in _parts(m, DISTANCE + 1)] for m in masks]


def _chain(diff: np.ndarray, budget: float, upto: int) -> np.ndarray:
    """Rows with a segment from which the sums over 1 to ``upto`` segments of the ring keep within the budget per segment."""
    m = diff.shape[1]
    ring = np.cumsum(np.concatenate([np.zeros((len(diff), 1), np.int32), diff, diff], axis=1), axis=1)
    ok = np.ones(diff.shape, bool)
    for n in range(1, upto + 1):
        ok &= ring[:, n : n + m] - ring[:, :m] <= int(n * budget)
    return ok.any(1)


def near_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    diff = np.bitwise_count(x.view(np.uint16).reshape(-1, SEGMENTS)).astype(np.int32)
    ok = np.flatnonzero(_chain(diff, DISTANCE / SEGMENTS, SEGMENTS - 1))
    out = np.zeros(len(x), bool)
    out[ok] = diff[ok].sum(1) <= DISTANCE
    return out


def near_lanes(most: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        diff = (a != b).reshape(len(a), KEYS, -1).sum(2, dtype=np.int32)
        ok = np.flatnonzero(_chain(diff, most / KEYS, 4))
        out = np.zeros(len(a), bool)
        out[ok] = diff[ok].sum(1) <= most
        return out

    return near


def near_octets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``near_bits``, of fingerprints as rows of eight bytes."""
    return near_bits(*(np.ascontiguousarray(x).view(np.uint64).ravel() for x in (a, b)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the pairs with the smallest node that it is connected to, itself left out."""
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links_of_runs(near: Callable, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within each run of equal (table, key), for rows (table, key, node, value) sorted by these."""

    def links(key: np.ndarray, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, held = [], [], 0
        i, d = np.arange(len(key) - 1), 1
        while len(i):
            i = i[i + d < len(key)]
            i = i[(key[i] == key[i + d]).all(1)]
            for at in range(0, len(i), 1 << 16):
                j = i[at : at + (1 << 16)]
                ok = j[near(value[j], value[j + d])]
                a.append(node[ok])
                b.append(node[ok + d])
                held += len(ok)
            if held > 1 << 20:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
            d += 1
        return forest(np.concatenate(a), np.concatenate(b)) if held else (np.zeros(0, np.int64),) * 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in [*_grouped(batches), None]:
            if b is not None:
                key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
                value = b.column(3).to_numpy().view(np.uint64) if width == 1 else np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, width)
                now = (key, b.column(2).to_numpy(), value)
                rest = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
                cut = np.flatnonzero((rest[0][1:] != rest[0][:-1]).any(1))
                done = int(cut[-1]) + 1 if len(cut) else 0
            else:
                done = len(rest[0]) if rest else 0
            if done:
                x, y = links(*(v[:done] for v in rest))
                rest = tuple(v[done:] for v in rest)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return work


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def _run_links(rows: DataFrame, near: Callable, width: int) -> DataFrame:
    dealt = rows.select("table", "key", "node", "value").repartition("table", "key").sortWithinPartitions("table", "key", "node")
    return dealt.mapInArrow(tidy(_links_of_runs(near, width)), "a long, b long")


def _shared_keys(keys: DataFrame) -> DataFrame:
    return keys.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")


def bit_links(classes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect the nodes of ``classes`` (node, fp) within the distance."""
    masks, rows, out = first_masks(), classes, None
    level = 0
    while True:
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        if level == 0:
            table = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("t")
            rows = classes.select("node", F.col("fp").alias("value"), table)
        else:
            child = F.explode(F.slice(F.array(*[F.struct(F.lit(i).alias("table"), F.lit(m).alias("mask")) for i, m in enumerate(signed)]), F.col("table") * (DISTANCE + 1) + 1, DISTANCE + 1)).alias("c")
            rows = rows.select("node", "value", child).select("node", "value", F.struct(F.col("c.table").alias("table"), F.col("value").bitwiseAND(F.col("c.mask")).alias("key")).alias("t"))
        rows = rows.select("t.table", "t.key", "node", "value")
        shared = stored(_shared_keys(rows), f"keys{level}")
        if level == 3:
            octets = F.unhex(F.lpad(F.hex("value"), 16, "0")).alias("lanes")
            return out.unionByName(covering_links(rows.select("table", "key", "node", octets), near_octets, group, "bits"))
        usual = shared.where(F.col("n") <= group)
        links = _run_links(rows.join(usual.select("table", "key"), ["table", "key"], "left_semi"), near_bits, 1)
        out = links if out is None else out.unionByName(links)
        hot = shared.where(F.col("n") > group)
        if hot.isEmpty():
            return out
        rows = stored(rows.join(hot.select("table", "key"), ["table", "key"], "left_semi"), f"hot{level}")
        masks = [m for some in deeper_masks(masks) for m in some]
        level += 1


def _pair_links(rows: DataFrame, near: Callable, similarity: float | None = None) -> DataFrame:
    """Links (a, b) that connect all near pairs within each run of equal (table, key, part), for rows (table, key, part, node, comp, side, lanes).

    Pairs that are connected already (by equal ``comp`` or by links of the run) are not compared, nor those of the same side unless it is -1.
    With a similarity the rows have the sorted shingle hashes too, and a pair that is near must be so similar.
    """
    exact = similarity is not None

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        less, more = sorted((len(a), len(b)))
        if less < similarity * more - 1e-9:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= similarity * (less + more - both) - 1e-9

    def links(key: np.ndarray, node: np.ndarray, comp: np.ndarray, side: np.ndarray, lanes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.r_[0, np.cumsum((key[1:] != key[:-1]).any(1))]
        own = np.arange(len(run))
        if (side >= 0).any():
            order = np.lexsort((own, comp, run))
            new = np.r_[True, (run[order][1:] != run[order][:-1]) | (comp[order][1:] != comp[order][:-1])]
            own[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))]
        label, i, d = own, np.arange(len(run) - 1), 1
        while len(i):
            i = i[i + d < len(run)]
            i = i[run[i] == run[i + d]]
            todo = i[(label[i] != label[i + d]) & ((side[i] < 0) | (side[i] != side[i + d]))]
            for at in range(0, len(todo), 1 << 14):
                j = todo[at : at + (1 << 14)]
                j = j[label[j] != label[j + d]]
                j = j[near(lanes[j], lanes[j + d])]
                if exact:
                    j = j[[similar(hashes[x], hashes[x + d]) for x in j.tolist()]] if len(j) else j
                if len(j):
                    x, y = forest(label[j], label[j + d])
                    to = np.arange(len(run))
                    to[x] = y
                    label = to[label]
            d += 1
        moved = label != own
        return node[moved], node[label[moved]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in chain(_grouped(batches), [None]):
            if b is not None:
                key = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
                lanes = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                hashes = np.empty(b.num_rows, object)
                if exact:
                    for i, x in enumerate(b.column(7).to_pylist()):
                        hashes[i] = np.frombuffer(x, np.uint64)
                now = (key, *(b.column(i).to_numpy() for i in (3, 4, 5)), lanes, hashes)
                rest = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
                cut = np.flatnonzero((rest[0][1:] != rest[0][:-1]).any(1))
                done = int(cut[-1]) + 1 if len(cut) else 0
            else:
                done = len(rest[0]) if rest else 0
            if done:
                x, y = links(*(v[:done] for v in rest))
                rest = tuple(v[done:] for v in rest)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    run = ["table", "key", "part"]
    names = [*run, "node", "comp", "side", "lanes", *(["hashes"] if exact else [])]
    types = {"table": "long", "key": "long", "part": "long", "node": "long", "comp": "long", "side": "int"}
    dealt = rows.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in names]).repartition(*run).sortWithinPartitions(*run, "node")
    return dealt.mapInArrow(tidy(work), "a long, b long")


def covering_links(rows: DataFrame, near: Callable, group: int, name: str, classes: DataFrame | None = None, similarity: float | None = None) -> DataFrame:
    """Links (a, b) that connect every near pair of nodes sharing a (table, key), whatever the number of rows of that key.

    ``rows`` are (table, key, node) with their lanes, or take these from ``classes``. Keys of up to ``group`` rows are compared whole. Larger ones are
    cut into parts with some common nodes in each, and the components are taken. Only where more than one is left in a key, the rows outside
    its largest component are compared with all rows of the key that they are not connected to, block by block.
    """
    by = ["table", "key"]
    values = [c for c in ("lanes", "hashes") if c in rows.columns]
    shared = stored(_shared_keys(rows), f"{name}_keys")
    hot = shared.where(F.col("n") > group)
    any_hot = not hot.isEmpty()

    def linked(some: DataFrame) -> DataFrame:
        return _pair_links(some if classes is None else some.join(classes.select("node", "lanes"), "node"), near, similarity)

    usual = rows.join(few(hot.select(by)), by, "left_anti") if any_hot else rows
    if classes is not None:
        usual = usual.join(shared.where(F.col("n") <= group).select(by), by, "left_semi")
    links = linked(usual.select(*by, F.lit(0).alias("part"), "node", F.col("node").alias("comp"), F.lit(-1).alias("side"), *values))
    if not any_hot:
        return links
    place = F.xxhash64("node", F.lit("part"))
    held = rows.join(few(hot), by).withColumn("parts", F.ceil(F.col("n") / group).cast("long"))
    held = stored(held.select(*by, "node", "parts", *values), f"{name}_hot")
    common = held.groupBy(*by, "parts").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(COMMON)])).alias("nodes"))
    common = stored(common.select(*by, F.explode("nodes").alias("node"), F.lit(True).alias("common")), f"{name}_common")
    everywhere = held.join(few(common), [*by, "node"], "left")
    own = F.when(F.col("common"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(place, F.col("parts"))))
    salted = everywhere.select(*by, F.explode(own).alias("part"), "node", F.col("node").alias("comp"), F.lit(-1).alias("side"), *values)
    links = stored(links.unionByName(linked(salted)), f"{name}_links")
    known = held.join(components(links), "node", "left").withColumn("comp", F.coalesce("component", "node"))
    known = stored(known.select(*by, "node", "comp", *values), f"{name}_known")
    left = known.groupBy(*by, "comp").agg(F.count("*").alias("n")).groupBy(by).agg(F.max_by("comp", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    left = stored(left.select(*by, "main", F.ceil(F.col("all") / group).cast("long").alias("p"), F.ceil((F.col("all") - F.col("most")) / group).cast("long").alias("q")), f"{name}_left")
    if left.isEmpty():
        return links
    still = known.join(few(left), by)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    whole = still.select("*", F.pmod(place, F.col("p")).alias("i"), upto("q").alias("j"), F.lit(0).alias("side"))
    outside = still.where("comp <> main").select("*", upto("p").alias("i"), F.pmod(place, F.col("q")).alias("j"), F.lit(1).alias("side"))
    blocks = whole.unionByName(outside).select(*by, (F.col("i") * F.col("q") + F.col("j")).alias("part"), "node", "comp", "side", *values)
    return links.unionByName(linked(blocks))


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link. Links (a, b) may come in any order.

    Rounds grow as the logarithm of a component's width, so ``rounds`` is never met; to be there without an end is an error.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for k in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"edges{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id): every document with the smallest id reachable over fingerprints that differ in at most 3 bits.

    A fingerprint is a node; ids come in at the end. Only rows of fingerprints that are linked or occur twice are joined.
    """
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.select("fp", F.col("fp").alias("node"), "least", "n"), "classes")
    moved = stored(components(bit_links(classes.select("node", "fp"), group)), "moved")
    linked = moved.unionByName(moved.select(F.col("component").alias("node"), "component").distinct())
    linked = stored(linked.join(classes.select("node", "least"), "node"), "linked")
    ids = stored(linked.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    copies = classes.where("n > 1").join(few(linked.select("node")), "node", "left_anti").select("fp", F.col("least").alias("component_id"))
    found = linked.join(few(ids), "component").select(F.col("node").alias("fp"), "component_id").unionByName(copies)
    out = marked.join(few(stored(found, "members")), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _similar(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, group: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node) for each row, a node for each set of shingles; and for each node its component and its first row."""
    factors = _multipliers(LANES)
    most = int(np.ceil(LANES * (1 - similarity) + 4 * (LANES * similarity * (1 - similarity)) ** 0.5))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release()
        step = LANES // KEYS
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(2)]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            least = np.stack([lane_minima(x, factors) for x in sets]) if sets else np.zeros((0, LANES), np.uint64)
            keys = np.zeros((b.num_rows, KEYS), np.uint64)
            for j in range(4):
                keys = (keys ^ least[:, j::step]) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
            lanes = (least & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([x.tobytes() for x in lanes], pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "lanes", "keys"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = pa.array([np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sets], ["key", "node", "lanes", "hashes"])

    keys = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_hash")]
    rows = docs.select(*keys, whole_text(text_col).alias("text"))
    marked = stored(rows.mapInArrow(tidy(work), "doc_id long, text_hash long, node long, lanes binary, keys array<long>"), "lanes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    classes = stored(marked.groupBy("node", "lanes", "keys").agg(first), "classes")
    near = near_lanes(most)
    coarse = components(covering_links(classes.select("node", F.posexplode("keys").alias("table", "key")), near, group, "lanes", classes))
    coarse = stored(coarse.select("node", "component").unionByName(coarse.select(F.col("component").alias("node"), "component").distinct()), "coarse")
    wanted = coarse.join(classes, "node").select(F.col("component").alias("key"), "node", "lanes", *_row_key(F.col("first.doc_id"), F.col("first.text_hash")))
    wanted = stored(wanted, "wanted")
    # Of all texts, those of one row of each of these nodes are shuffled, and the few that the filter lets through besides.
    asked = bloom.marked(rows, F.xxhash64("doc_id", "text_hash"), wanted.select(_filter_key().alias("key")), "_wanted").where("_wanted")
    texts = asked.select(*_row_key(F.col("doc_id"), F.col("text_hash")), "text").groupBy(ROW_KEY).agg(F.first("text").alias("text"))
    sets = wanted.join(texts.hint("merge"), ROW_KEY).select("key", "node", "lanes", "text").mapInArrow(tidy(whole), "key long, node long, lanes binary, hashes binary")
    sets = stored(sets.select(F.lit(0).alias("table"), "key", "node", "lanes", "hashes"), "sets")
    found = components(covering_links(sets, near, min(group, TEXTS), "sets", similarity=similarity))
    return marked.select("doc_id", "text_hash", "node"), classes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, group: int = GROUP) -> DataFrame:
    """(doc_id, component_id), the smallest id reachable over texts whose sets of shingles are at least so similar; null if no id is."""
    marked, nodes = _similar(docs, id_col, text_col, words, similarity, group)
    nodes = stored(nodes, "components")
    ids = nodes.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    return marked.join(nodes.join(ids, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


ROW_KEY = ["_no_id", "_id", "_text"]


def _row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """What tells rows apart, without nulls."""
    return [doc_id.isNull().alias("_no_id"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("_id"), text_hash.alias("_text")]


def _filter_key() -> Column:
    return F.xxhash64(F.when(~F.col("_no_id"), F.col("_id")), "_text")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, group: int = GROUP) -> DataFrame:
    """The documents, one row of each component: that of the smallest id, nulls last, then of the smallest text hash; all columns stay as they are.

    Rows to drop, and those that occur repeatedly, are put into a Bloom filter. What doesn't pass it stays as it is, without a shuffle. What passes is
    joined with these rows.
    """
    marked, nodes = _similar(docs, id_col, text_col, words, similarity, group)
    nodes = stored(nodes, "components")
    best = nodes.groupBy("component").agg(F.min("first").alias("best"))
    each = marked.groupBy("node", "doc_id", "text_hash").agg((F.count("*") > 1).alias("_again")).join(nodes.select("node", "component"), "node").join(best, "component")
    goes = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    open_ = stored(each.select(*_row_key(F.col("doc_id"), F.col("text_hash")), goes.alias("_goes"), "_again").where("_goes OR _again"), "open")
    keyed = docs.select(*docs.columns, *_row_key(F.col(id_col).cast("long"), F.xxhash64(whole_text(text_col))))
    keyed = bloom.marked(keyed, _filter_key(), open_.select(_filter_key().alias("key")), "_open")
    joined = keyed.where("_open").join(open_.hint("merge"), ROW_KEY, "left")
    one = joined.where("NOT _goes").dropDuplicates(ROW_KEY)
    out = [keyed.where("NOT _open"), joined.where("_goes IS NULL"), one]
    return reduce(DataFrame.unionByName, [x.select(docs.columns) for x in out])
