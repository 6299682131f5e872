"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are compared on a ring of eight segments of eight bits. If two of them differ in at most
`distance` bits, then from some segment on, every run of l consecutive segments differs in at most
floor(l * distance / 8) bits (the pigeonring principle). With a distance of 3 the first two segments of such a chain
are equal and the next three hold one difference at most, so one half of these three is equal too: a key of 16 + 12 equal
bits finds the pair, the chain is checked, and the whole Hamming distance is checked last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, few, forget, fresh, rows_of, words, written
from .components import components

SEGMENTS = 8
#: A key with more fingerprints than this is searched in blocks of this size, each pair of blocks by a task of its own.
BLOCK = 64
#: Shingles whose bits are counted at once.
SLICE = 65_536


def shingle_hashes(tokens: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `width` words, joined by spaces; of all words if they are fewer; none of no words."""
    if not tokens:
        return np.empty(0, np.uint64)
    text, n = b" ".join(tokens), len(tokens)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(text, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], seed) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; texts that are null, empty or blank have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(words(text), width)) for (text,) in rows_of([batch], "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def rotated(x: Column, segment: int) -> Column:
    """The bits so that segment `segment` (0: highest) comes first."""
    by = 64 // SEGMENTS * segment
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def chain_holds(x: Column, distance: int) -> Column:
    """Whether the differing bits x, rotated to the chain's start, stay within budget for every run of segments."""
    out = F.lit(True)
    for run in range(1, SEGMENTS + 1):
        part = F.shiftrightunsigned(x, 64 - 64 // SEGMENTS * run) if run < SEGMENTS else x
        out &= F.bit_count(part) <= F.lit(run * distance // SEGMENTS)
    return out


def index_keys(fps: DataFrame) -> DataFrame:
    """key, start, fp: sixteen keys for each fingerprint, each of the chain's start, the half that is equal, and 28 bits."""
    made = []
    for s in range(SEGMENTS):
        x = rotated(F.col("fp"), s)
        head = F.shiftrightunsigned(x, 48)
        for half in range(2):
            part = F.shiftrightunsigned(x, 36 - 12 * half).bitwiseAND(F.lit(0xFFF).cast("long"))
            made.append(F.struct(F.lit(s).alias("start"), (F.lit((s * 2 + half) << 28).cast("long") + F.shiftleft(head, 12) + part).alias("key")))
    return fps.select("fp", F.explode(F.array(*made)).alias("k")).select("k.key", "k.start", "fp")


def block_links(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    """A spanning forest of the links among the fingerprints of one pair of blocks: at most as many rows as there are fingerprints."""
    fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    side = pdf["block"].to_numpy()
    start = int(pdf["start"].iloc[0])
    turned = np.roll(fps.astype(">u8").view(np.uint8).reshape(-1, 8), -start, axis=1)
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    limits = np.arange(1, SEGMENTS + 1) * distance // SEGMENTS
    diff = np.bitwise_count(turned[left][:, None, :] ^ turned[right][None, :, :]).cumsum(axis=2, dtype=np.int16)
    near = (diff <= limits).all(axis=2)
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = int(left[i]), int(right[j])
        if a != b and (x := root(a)) != (y := root(b)):
            parent[x] = y
            out.append((int(fps[a].astype(np.int64)), int(fps[b].astype(np.int64))))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """a, b: pairs of distinct fingerprints that connect whatever is linked at `distance` (1 to 3) or fewer bits.

    Keys with up to BLOCK fingerprints give all their pairs. Larger ones are cut into blocks; each pair of blocks gives a
    spanning forest of its links, so no link between components is lost and no group's pairs are all written out.
    """
    if not 0 < distance <= 3:
        raise ValueError("the index keys hold for distances from 1 to 3")
    keys = index_keys(fps)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keys = keys.join(sizes, "key")
    few = keys.filter(F.col("n") <= BLOCK).select("key", "start", "fp")
    other = few.select("key", F.col("fp").alias("b"))
    x = F.col("fp").bitwiseXOR(F.col("b"))
    turned = rotated(x, 0)
    for s in range(1, SEGMENTS):
        turned = F.when(F.col("start") == s, rotated(x, s)).otherwise(turned)
    pairs = few.join(other, "key").filter((F.col("fp") < F.col("b")) & (F.bit_count(x) <= distance)).filter(chain_holds(turned, distance)).select(F.col("fp").alias("a"), "b")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = keys.filter(F.col("n") > BLOCK).withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("fp"), blocks).cast("int")})
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", "start", "fp", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    forest = many.groupBy("key", "b1", "b2").applyInPandas(lambda pdf: block_links(pdf, distance), "a long, b long")
    return pairs.unionByName(forest).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    Documents whose fingerprints differ in at most `distance` bits are linked; component_id is the smallest doc_id that
    links reach. Texts without words (null, empty, blank) have fingerprint zero and are linked like any others. Repeated
    rows come out as often as they went in. A null doc_id keeps its row and counts as larger than any other. Other
    columns aren't read. Without rows the result is empty.
    """
    own = checkpoint(fingerprints(docs, width))
    classes = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(classes.select(F.col("fp").alias("node"), F.col("least").alias("label")), checkpoint(links(classes.select("fp"), distance)))
    found = found.select(F.col("node").alias("fp"), F.col("label").alias("component_id"))
    return own.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similarities that 64 bits are too few for: bits of a wide fingerprint, one segment of the ring being a byte of them.
WIDE = 2048
#: Least Jaccard similarity. Texts of 0.8 have a cosine of 0.89 and differ in 15.1 % of the bits, with a standard deviation of 0.79 %: three of
#: them below, a pair is taken as it is; up to three above, the shingles themselves are compared.
LEAST_JACCARD, SURE, LOOSE = 0.8, int(WIDE * 0.127), int(WIDE * 0.175)
#: Consecutive equal segments that begin a chain; the places of the ring that are looked at first; members of a key that are ordered together; of a block.
CHAIN, FIRST_STEP, MEETING, WIDE_BLOCK = 3, 4, 1024, 256
#: Fingerprints whose keys one task spells out and counts at once.
SPELT = 3000
ORDER = np.random.default_rng(7).permutation(WIDE)


def wide_bits(hashed: list[np.ndarray]) -> np.ndarray:
    """WIDE / 8 bytes for each text: the signs of WIDE orthogonal projections (Walsh-Hadamard) of its distinct shingle hashes, signed."""
    v = np.zeros((len(hashed), WIDE), np.float32)
    for i, h in enumerate(hashed):
        h = np.unique(h)
        sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float)
        heavier = (h >> np.uint64(41)).astype(float) / (1 << 23) / 100  # so that few shingles don't cancel out
        v[i] = np.bincount((h % np.uint64(WIDE)).astype(np.int64), weights=sign * (1 + heavier), minlength=WIDE)
    step = 1
    while step < WIDE:
        x = v.reshape(len(hashed), -1, 2, step)
        v = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(hashed), WIDE)
        step *= 2
    return np.packbits(v[:, ORDER] > 0, axis=1)


def wide_fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """node, doc_id, same (a digest of the words), bits (longs) of the rows (node, doc_id, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                own = [words(text) for text in batch.column(2).slice(at, 128).to_pylist()]
                kept = [k for k, w in enumerate(own) if w]
                b = np.ascontiguousarray(wide_bits([shingle_hashes(own[k], width) for k in kept])).view(np.int64)
                same = [hashlib.blake2b(b" ".join(own[k]), digest_size=16).digest() for k in kept]
                place = pa.array([at + k for k in kept], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, WIDE // 64), pa.int32()), pa.array(b.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(same, pa.binary()), lists], ["node", "doc_id", "same", "bits"])

    return rows.select("node", "doc_id", "text").mapInArrow(run, f"node long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, same binary, bits array<long>")


def ring_keys(step: int) -> Column:
    """A number for each `step`-th place of the ring, of the place and the CHAIN segments from it on."""
    n, mask = WIDE // 64, (1 << 8 * CHAIN) - 1
    return F.expr(
        f"transform(sequence(0, {WIDE // 8 - 1}, {step}), p -> shiftleft(cast(p as bigint), {8 * CHAIN}) | ({mask}L & (shiftrightunsigned(bits[p div 8], 8 * (p % 8))"
        f" | if(p % 8 > {8 - CHAIN}, shiftleft(bits[(p div 8 + 1) % {n}], 64 - 8 * (p % 8)), 0L))))"
    )


def differing() -> Column:
    return F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def measured(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, d: the pairs (a, b) that differ in at most LOOSE bits, and in how many."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b")
    return both.select("a", "b", differing().alias("d")).filter(F.col("d") <= LOOSE)


def first_links(nodes: DataFrame) -> DataFrame:
    """a, b, d of neighbours in the keys of every FIRST_STEP-th place, by an order that is the same for every key: few links that join the copies of a group."""
    keys = nodes.select("node", F.explode(ring_keys(FIRST_STEP)).alias("key")).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    dealt = keys.withColumn("order", F.xxhash64("node")).withColumn("salt", F.pmod(F.col("order"), F.ceil(F.col("n") / MEETING)))
    near = dealt.select("node", F.lag("node").over(Window.partitionBy("key", "salt").orderBy("order", "node")).alias("other"))
    pairs = near.filter("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    return measured(pairs, nodes)


def similar_links(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b: links that connect whatever of `nodes` (node, bits) meets, differs in at most LOOSE bits and is similar.

    Fingerprints meet where CHAIN consecutive segments of the ring are equal. first_links() joins most copies. Then keys are looked at whose
    members still lie in different components: a key of two members is a pair; members of larger ones are
    compared across components in blocks (`links_left`), so none that meet are left out. Members of a key are counted by windows, which
    spill; equal texts are one member, so a key is as large as the number of different texts that share its bits.
    """
    near = written(first_links(nodes))
    first = written(similar(near, texts, width))
    label = components(nodes.select("node", F.col("node").alias("label")), first)
    labelled = written(nodes.join(label, "node"))
    spread = labelled.select("node", "label", "bits").repartition(-(-max(1, labelled.count()) // SPELT))
    own = Window.partitionBy("key")
    met = spread.select("node", "label", F.explode(ring_keys(1)).alias("key")).withColumns({"n": F.count("*").over(own), "low": F.min("label").over(own), "high": F.max("label").over(own)})
    met = written(met.filter("low < high").select("key", "node", "label", "n"))
    pairs = measured(met.filter("n = 2").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b").distinct(), nodes)
    rest = written(pairs.unionByName(links_left(labelled, met.filter("n > 2").select("key", "node", "label"))))
    found = written(first.unionByName(similar(rest, texts, width)))
    forget(near, first, labelled, met, rest)
    return found


def links_left(labelled: DataFrame, met: DataFrame) -> DataFrame:
    """a, b, d: links between components (`label`) among all that meet in a key (`met`: key, node, label).

    A key's largest component isn't compared with itself. It and the key's others are cut into blocks of about WIDE_BLOCK; each block of
    others meets each block, and gives one sure link for each two components, or every pair that may be similar. The bits are joined to nodes, each with the
    list of its blocks (at most one for each place of the ring), and not to its places one by one.
    """
    own = Window.partitionBy("key")
    sized = met.withColumn("_same", F.count("*").over(Window.partitionBy("key", "label"))).withColumns({"_n": F.count("*").over(own), "_top": F.max(F.struct(F.col("_same").alias("most"), F.col("label").alias("top"))).over(own)})
    sized = sized.withColumns({"tops": F.ceil(F.col("_top.most") / WIDE_BLOCK).cast("int"), "rest": F.ceil((F.col("_n") - F.col("_top.most")) / WIDE_BLOCK).cast("int"), "is_top": F.col("label") == F.col("_top.top")})
    # Blocks of others have the numbers from 0 on, those of the largest component follow.
    block = F.pmod(F.xxhash64("node", "key"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rest"))).cast("int") + F.when(F.col("is_top"), F.col("rest")).otherwise(0)
    last = F.when(F.col("is_top"), F.col("rest")).otherwise(F.col("rest") + F.col("tops")) - 1
    places = sized.select("node", "label", F.struct("key", block.alias("block"), last.alias("last")).alias("place")).groupBy("node", "label").agg(F.collect_list("place").alias("places"))
    dealt = places.join(labelled.select("node", "bits"), "node").select("node", "label", "bits", F.explode("places").alias("p")).select("node", "label", "bits", "p.key", "p.block", F.explode(F.sequence(F.lit(0), F.col("p.last"))).alias("other"))
    dealt = dealt.select("key", "node", "label", "bits", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    return dealt.groupBy("key", "b1", "b2").applyInPandas(wide_links, "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def wide_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Between a block and itself or another one: for each two labels one link of at most SURE differing bits, or where there is none every pair of at most LOOSE: the nearest by bits may be unlike, and a farther one similar."""
    side, ids = pdf["block"].to_numpy(), pdf["node"].to_numpy(dtype=np.int64)
    bits, labels = np.stack(pdf["bits"].to_list()).view(np.uint64), pd.factorize(pdf["label"])[0]
    right, alone = np.flatnonzero(side == side.max()), side.min() == side.max()
    sure: dict[tuple[int, int], tuple] = {}
    near: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(side == side.min()):
        others = right[labels[right] != labels[i]]
        if alone:
            others = others[others > i]
        d = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for k in np.flatnonzero(d <= SURE):
            j = others[k]
            sure.setdefault((min(labels[i], labels[j]), max(labels[i], labels[j])), (ids[i], ids[j], d[k]))
        loose = (d > SURE) & (d <= LOOSE)
        near.append((i, others[loose], d[loose]))
    joined: dict[int, list[int]] = {}
    for one, two in sure:
        joined.setdefault(one, []).append(two)
        joined.setdefault(two, []).append(one)
    found = [np.array(list(sure.values()), dtype=np.int64).reshape(-1, 3)]
    for i, others, d in near:
        left = ~np.isin(labels[others], joined.get(labels[i], []))
        found.append(np.column_stack([np.full(left.sum(), ids[i]), ids[others[left]], d[left]]))
    every = np.concatenate(found)
    return pd.DataFrame({"a": every[:, :2].min(axis=1), "b": every[:, :2].max(axis=1), "d": every[:, 2].astype(np.int32)})


def similar(links: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b: the links that are sure, and those whose texts (node, text) have a Jaccard similarity of LEAST_JACCARD or more on their distinct shingles."""
    open_ = links.filter(F.col("d") > SURE).select("a", "b").distinct()
    some = texts.join(few(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    both = open_.join(some.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in rows_of([batch], "x", "y"):
                p, q = (np.unique(shingle_hashes(words(t), width)) for t in (x, y))
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(same >= LEAST_JACCARD * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    exact = both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
    return links.filter(F.col("d") <= SURE).select("a", "b").unionByName(exact)


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of each group of near duplicates, linked by a Jaccard similarity of LEAST_JACCARD or more on shingles of `width` words: the one with the smallest doc_id,
    of equal ids the one with the smallest digest of its words. Columns, whatever their names, stay as they are.

    Texts with equal words (letters A to Z in either case) are copies; repeated rows leave one. Rows with one doc_id and unlike texts are documents of their own. Rows whose
    text has no words (null, empty, blank) or whose doc_id is null are kept, all of them: nothing says that they are copies. A very long text is
    compared whole. Without rows the result is empty.
    """
    row = fresh(docs, "_row")
    own = written(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = own.select(F.col(row).alias("node"), "doc_id", "text").filter("doc_id is not null and text is not null")
    marked = written(wide_fingerprints(texts, width))
    nodes = marked.groupBy("same").agg(F.min(F.struct("doc_id", "node")).alias("f"), F.first("bits").alias("bits"))
    nodes = written(nodes.select("f.node", "f.doc_id", "same", "bits"))
    found = similar_links(nodes.select("node", "bits"), texts.select("node", "text"), width)
    best = components(nodes.select("node", F.struct("doc_id", "same", "node").alias("label")), found)
    gone = written(marked.select("node").join(best.filter("label.node = node").select("node"), "node", "left_anti"))
    forget(marked, nodes, found)
    return own.join(few(gone.withColumnRenamed("node", row)), row, "left_anti").select(*docs.columns)
