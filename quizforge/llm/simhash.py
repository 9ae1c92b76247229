"""SimHash near-dedup: a byte-position inverted index with count filtering.

Fingerprints within ``2`` differing bits share at least 6 of their 8 positional bytes. Every distinct fingerprint
is posted under positional bytes, for a pair to meet without listing all fingerprints of one byte: the postings are
sets of four positions, chosen so that any two positions are left out by one of them. Where fingerprints meet,
the positional bytes that each pair shares are tallied, pairs under the guaranteed 6 go, and the rest are verified bit
by bit. What comes out are links to a representative, and components are joined over representatives only; copies
never pair up.

A posting with over ``CROWDED`` fingerprints is not tallied: its fingerprints are posted anew under each choice of 6
positions, where all pairs have the guaranteed count. Such a posting leaves two bytes open, so it has at most 65,536
fingerprints whatever the corpus, and neighbours are looked up by flipping bits. No link is lost in either way.

Defined results: a null or wordless text has fingerprint zero, linked like any other; repeated rows get the
same class; a null doc_id is ignored when the smallest id of a class is taken (null if there is no other);
other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizforge.llm.common import mixed, shared_dir, stored, text_chunks

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Positional bytes that a pair within MAX_BITS shares at least.
LEAST_SHARED = 8 - MAX_BITS
#: Four positions each; for any two positions there is one of these that has neither.
QUADS = tuple(a + b for a, b in combinations(((0, 1), (2, 3), (4, 5), (6, 7)), 2))
#: Fingerprints of one posting that are tallied pair by pair.
CROWDED = 2048
#: The looser pass: texts whose fingerprints of words, each counted WORD_WEIGHT times at most, are within WORD_BITS bits are
#: candidates (heavier weights let common words decide, so that unlike texts meet), and so are those that share a band of
#: BAND least shingle hashes, as they do at a similarity of 0.8 in 99.97 of 100 cases. Texts whose sketches of WIDE * 64 bits
#: over distinct shingles of WIDE_SHINGLE words are within WIDE_BITS are near copies. At a Jaccard similarity of 0.81 sketches
#: differ in 150 bits of 1,024 on average, in 186 at 0.72.
WORD_WEIGHT, WORD_BITS, WIDE, WIDE_SHINGLE, WIDE_BITS, BAND = 8, 3, 16, 5, 160, 2
#: First texts of a posting that all others are compared with before the pairs of what they don't reach.
PIVOTS = 128
#: For any three positions there is one of these that has none of them.
WORD_QUADS = tuple(q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0)
#: Byte value -> eight byte lanes, one for each bit, so that up to 255 values add up without carry.
_SPREAD = np.array([sum(1 << (8 * j) for j in range(8) if v >> j & 1) for v in range(256)], np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of lower-cased words; the whole sequence if there are fewer words."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprints_of(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list: a bit is 1 if it is set in over half of the hashes."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    return majorities(np.fromiter((h for own in hashes for h in own), np.uint64, int(sizes.sum())), sizes)


def majorities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As ``fingerprints_of``, for hashes that follow each other, so many for each list."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not full.size:
        return out
    sizes = sizes[full]
    blocks = -(-sizes // 255)
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    at = np.repeat(np.cumsum(sizes) - sizes, blocks) + 255 * within
    lanes = np.add.reduceat(_SPREAD[flat.view(np.uint8).reshape(-1, 8)], at, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), first_block, axis=0)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            hashes = [shingle_hashes(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            fp = fingerprints_of(hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(fp)], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) for every row: a hash of the whole text, and the fingerprint's 64 bits as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")
    return docs.select("doc_id", text, key).mapInArrow(_fingerprint_batches, f"doc_id {kind}, text_key long, fp long")


def tallied(fps: np.ndarray) -> np.ndarray:
    """For the distinct fingerprints of a posting, each one's representative: the smallest it reaches by links."""
    shared = np.zeros((len(fps), len(fps)), np.uint8)
    for column in fps.view(np.uint8).reshape(-1, 8).T:
        shared += column[:, None] == column[None, :]
    a, b = np.nonzero(shared >= LEAST_SHARED)
    close = np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS
    a, b = a[close], b[close]
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return fps[label]
        label = new


def looked_up(fps: np.ndarray) -> np.ndarray:
    """As ``tallied``, for fingerprints that differ in at most two bytes: each value's neighbours are looked up."""
    base = fps[0]
    odd = np.bitwise_or.reduce(fps ^ base)
    open_bits = [b for b in range(64) if int(odd) >> b & 1]
    squeezed = np.zeros(len(fps), np.int64)
    for k, b in enumerate(open_bits):
        squeezed |= (((fps ^ base) >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    flips = [0] + [1 << k for k in range(len(open_bits))] + [1 << i | 1 << j for i, j in combinations(range(len(open_bits)), 2)]
    there = np.full(1 << len(open_bits), len(fps), np.int64)
    there[squeezed] = np.arange(len(fps))
    while True:
        new = np.min([there[squeezed ^ f] for f in flips], axis=0)
        if (new == there[squeezed]).all():
            return fps[new]
        there[squeezed] = new


def _linker(link: Callable[..., tuple[np.ndarray, np.ndarray]]):
    """Over rows sorted by (combo, bytes): ``link`` of each posting's other columns; one may go on in the next batch."""

    def links(combo: np.ndarray, key: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        found: set[tuple[int, int]] = set()
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            own, to = link(*(c[a:b] for c in columns))
            moved = to != own
            found.update(zip(own[moved].tolist(), to[moved].tolist(), strict=True))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest:
                now = [np.concatenate(both) for both in zip(rest, now, strict=True)]
            combo, key = now[:2]
            if not len(key):
                continue
            last = len(key) - 1
            same = (combo == combo[last]) & (key == key[last])
            cut = len(key) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield links(*(x[:cut] for x in now))
        if rest:
            yield links(*rest)

    return run


def _of_fingerprints(reach: Callable[[np.ndarray], np.ndarray]):
    """A link function over a posting's fingerprints."""

    def link(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.unique(fp).view(np.uint64)
        return own.view(np.int64), reach(own).view(np.int64)

    return link


def postings(distinct: DataFrame, choices: Iterable[tuple[int, ...]], *more: str) -> DataFrame:
    """(combo, bytes, fp, and columns ``more``): each fingerprint under the bytes at each choice of positions."""
    masks = []
    for chosen in choices:
        value = sum(0xFF << (8 * p) for p in chosen)
        masks.append(value - (1 << 64) if value >> 63 else value)
    keys = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)])
    return distinct.select("fp", *more, F.explode(keys).alias("k")).select("k.combo", "k.bytes", "fp", *more)


def index_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``, enough to join all that are linked."""

    def linked(posted: DataFrame, link: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        dealt = posted.repartition("combo", "bytes").sortWithinPartitions("combo", "bytes")
        return dealt.mapInArrow(_linker(_of_fingerprints(link)), "a long, b long")

    posted = postings(distinct, QUADS)
    # Most postings have one fingerprint: they are counted, with sums before the shuffle, and only the others travel.
    sizes = posted.groupBy("combo", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = stored(sizes.select("combo", "bytes", (F.col("n") > CROWDED).alias("crowded")), "postings")
    met = stored(posted.join(shared, ["combo", "bytes"]), "met")
    few = linked(met.where(~F.col("crowded")).select("combo", "bytes", "fp"), tallied)
    many = linked(postings(met.where("crowded").select("fp").distinct(), combinations(range(8), LEAST_SHARED)), looked_up)
    return few.unionByName(many).distinct()


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every linked fingerprint: the smallest one of its component.

    Each round hands every fingerprint the smallest label next to it, then follows labels one step; both joins
    read stored tables, so a fingerprint with very many links can be split over tasks.
    """
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        said = both.join(labels, both.b == labels.fp).select(F.col("a").alias("fp"), "root")
        near = stored(labels.unionByName(said).groupBy("fp").agg(F.min("root").alias("root")), "labels")
        hop = near.select(F.col("fp").alias("root"), F.col("root").alias("next"))
        labels = stored(near.join(hop, "root").select("fp", F.least("root", "next").alias("root")), "labels")
        before, total = total, labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
    return labels


def near_duplicate_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id, root): one row for each document.

    ``component_id`` is the smallest doc_id reachable by links of 2 or fewer differing bits; ``root`` names the
    class even where its ids are null.
    """
    shared_dir(docs.sparkSession)
    fps = stored(fingerprints(docs, text), "fingerprints")
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep_id")), "representatives")
    labels = components(index_links(reps.select("fp")))
    linked = stored(reps.join(labels, "fp"), "linked")
    smallest = stored(linked.groupBy("root").agg(F.min("rep_id").alias("component_id")), "smallest")
    classes = stored(linked.select("fp", "root").join(smallest, "root"), "classes").select("fp", "root", "component_id")
    known = stored(
        reps.join(classes, "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("rep_id")).otherwise(F.col("component_id")).alias("component_id")
        ),
        "known",
    )
    return fps.join(known, "fp").select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def representatives(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (null ids last; repeated rows give one).

    Only the ids and text hashes of rows that go, or that are repeated, are joined to the texts.
    """
    classes = near_duplicate_classes(docs, text).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    classes = stored(classes, "classes")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("f"))
    is_first = F.col("c.doc_id").eqNullSafe(F.col("f.f.doc_id")) & (F.col("c.text_key") == F.col("f.f.text_key"))
    others = classes.alias("c").join(first.alias("f"), F.col("c.root") == F.col("f.root")).select("c.doc_id", "c.text_key", "n", is_first.alias("stays"))
    others = stored(others.where(~F.col("stays") | (F.col("n") > 1)), "others")
    repeated = others.where("stays").select("doc_id", "text_key")
    key = F.xxhash64(F.coalesce(F.col(f"d.{text}"), F.lit("")))
    same = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (key == F.col("o.text_key"))
    kept = docs.alias("d").join(others.alias("o"), same, "left_anti")
    if repeated.isEmpty():
        return kept
    # One row of each repeated one; the columns travel as one value, so that no name can clash.
    rows = docs.alias("d").join(repeated.alias("o"), same, "left_semi").select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("r"), key.alias("k"))
    once = rows.groupBy(F.col(f"r.doc_id").alias("i"), "k").agg(F.first("r").alias("r")).select("r.*")
    return kept.unionByName(once)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "node", "fp", "bands", *(f"s{i}" for i in range(WIDE))]
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            words, shingles = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                text = data[a:b].tobytes()
                counts = Counter(text.lower().split())
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts))
                words.append(np.repeat(hashes, np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), WORD_WEIGHT)))
                shingles.append(np.unique(np.array(shingle_hashes(text, WIDE_SHINGLE), np.uint64)))
            every, counts = np.concatenate(words), np.fromiter(map(len, words), np.int64, len(words))
            fp = majorities(every, counts)
            flat, sizes = np.concatenate(shingles), np.fromiter(map(len, shingles), np.int64, len(shingles))
            wide, least, full = [], np.zeros((len(sizes), WIDE), np.uint64), np.flatnonzero(sizes)
            for k in range(WIDE):
                drawn = mixed(flat + np.uint64(k))
                wide.append(majorities(drawn, sizes))
                if len(full):
                    least[full, k] = np.minimum.reduceat(drawn, (np.cumsum(sizes) - sizes)[full])
            band = least[:, ::BAND].copy()
            for k in range(1, BAND):
                band = mixed(band * np.uint64(3) + least[:, k::BAND])
            bands = pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), WIDE // BAND).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(fp.view(np.int64)), bands, *(pa.array(x.view(np.int64)) for x in wide)], names)


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, node, fp, bands, s0 to s15): a hash of the whole text, the fingerprint of its words, the bands of its least shingle hashes, their sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node")
    return docs.select("doc_id", text, key).mapInArrow(_sketch_batches, f"doc_id {kind}, node long, fp long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(WIDE)))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after a and b are linked, pair by pair: the smallest place of each component."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        root = np.arange(len(label))
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        label = root[label]
        other = label[a] != label[b]
        a, b = a[other], b[other]
    return label


def near_in_posting(node: np.ndarray, fp: np.ndarray, *wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of a posting and the first one it reaches by links: close fingerprints, then close sketches.

    In a large group of copies nearly all are close to its first one, so all texts are compared with a few first ones, and then
    only pairs that these have not joined, some rows at a time: memory is bounded by the posting.
    """
    fp, sketch = np.ascontiguousarray(fp).view(np.uint64), np.ascontiguousarray(np.stack(wide, axis=1)).view(np.uint64)
    near = lambda a, b: np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=-1, dtype=np.int64) <= WIDE_BITS
    n = len(node)
    label, rest = np.arange(n), np.arange(n)
    for _ in range(PIVOTS if n > PIVOTS else 0):
        if not len(rest):
            break
        reached = np.flatnonzero(np.bitwise_count(fp[rest] ^ fp[rest[0]]) <= WORD_BITS)
        reached = reached[near(rest[reached], rest[0])]
        label[rest[reached]] = rest[0]
        rest = np.delete(rest, reached)
    order = np.argsort(label, kind="stable")
    ends = np.searchsorted(label[order], label[order], "right")  # what a pivot has joined is in one run
    at = 0
    while at < n and ends[at] < n:
        first = int(ends[at])
        step = max(1, (1 << 19) // (n - first))
        rows = order[at : at + step]
        a, b = np.nonzero(np.bitwise_count(fp[rows, None] ^ fp[None, order[first:]]) <= WORD_BITS)
        apart = b + first >= ends[at + a]
        a, b = rows[a[apart]], order[b[apart] + first]
        other = label[a] != label[b]
        a, b = a[other], b[other]
        close = near(a, b)
        label = _merged(label, a[close], b[close])
        at += len(rows)
    return node, node[label]


def sketch_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between near copies among ``nodes`` (as ``sketches`` gives them), enough to join all that are linked."""
    wide = [f"s{i}" for i in range(WIDE)]

    def met(posted: DataFrame) -> DataFrame:
        sizes = posted.groupBy("combo", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        shared = stored(sizes.select("combo", "bytes", (F.col("n") > CROWDED).alias("crowded")), "postings")
        return stored(posted.join(shared, ["combo", "bytes"]), "met")

    def linked(meeting: DataFrame) -> DataFrame:
        # Sketches join only where texts meet.
        full = meeting.select("combo", "bytes", "node", "fp").join(nodes.select("node", *wide), "node").select("combo", "bytes", "node", "fp", *wide)
        return full.repartition("combo", "bytes").sortWithinPartitions("combo", "bytes").mapInArrow(_linker(near_in_posting), "a long, b long")

    # In a band all texts are candidates, whatever their fingerprints.
    bands = nodes.select("node", F.posexplode("bands").alias("combo", "bytes")).select((F.col("combo") + 100).alias("combo"), "bytes", F.lit(0).cast("long").alias("fp"), "node")
    first = met(postings(nodes, WORD_QUADS, "node").unionByName(bands))
    by_words = F.col("combo") < 100
    again = met(postings(first.where("crowded").where(by_words).select("node", "fp").distinct(), combinations(range(8), 8 - WORD_BITS), "node"))
    return linked(first.where(~F.col("crowded") | ~by_words)).unionByName(linked(again)).where("a != b").distinct()


def one_of_each_group(docs: DataFrame, text: str = "text") -> DataFrame:
    """``representatives``, and of those one row of each group of near copies in five-word shingles.

    Near copies have a similarity of about 0.8 or more, estimated from sketches. Candidates have fingerprints of words within 3
    bits, which share 5 of 8 positional bytes at least and meet under sets of four positions (those of a posting with over
    ``CROWDED`` texts anew under all sets of five), or share a band of least shingle hashes. Where they meet, all pairs
    that a first round of comparisons has not joined are looked at.
    """
    left = stored(representatives(docs, text), "tight")
    nodes = stored(sketches(left, text), "sketches")
    labels = components(sketch_links(nodes))
    classes = stored(nodes.select("doc_id", "node").join(labels.withColumnRenamed("fp", "node"), "node"), "loose")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("f"))
    is_first = F.col("c.doc_id").eqNullSafe(F.col("f.f.doc_id")) & (F.col("c.node") == F.col("f.f.node"))
    others = stored(classes.alias("c").join(first.alias("f"), F.col("c.root") == F.col("f.root")).where(~is_first).select("c.doc_id", "c.node"), "others")
    key = F.xxhash64(F.coalesce(F.col(f"d.{text}"), F.lit("")))
    return left.alias("d").join(others.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (key == F.col("o.node")), "left_anti")
