"""SimHash near-duplicates, compared by bit-sliced counters.

Fingerprints within ``RADIUS`` = 2 bits agree on at least one of three blocks of
their 64 bits, so only fingerprints with an equal block meet.  Inside such a bucket
the fingerprints are stored as 64 bit planes.  Shifting the planes by d places sets
every fingerprint against the d-th next one; their differences are added up by a
carry-save counter for all places at once, and a shift is abandoned as soon as every
place has exceeded the radius.

A bucket reports a spanning forest of its links, never all its pairs.  A bucket with
more than ``MOST`` distinct fingerprints is not compared by shifts: two fingerprints
are within two bits exactly if some value is within one bit of both, so each sends
its 65 such values and equal values meet, which is linear in the bucket.

The links are joined to components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialise, read

RADIUS = 2
SHINGLE, SEED = 3, 42
MOST = 1 << 14
#: First bit and width of the blocks
BLOCKS = ((0, 22), (22, 21), (43, 21))
_U = np.uint64


def fingerprint(raw: bytes) -> int:
    """SimHash of a text's UTF-8 bytes, as an unsigned integer."""
    words = raw.lower().split()  # bytes: ASCII letters and the six ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    gap = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20)
    start = np.concatenate(([0], gap + 1))[: len(words) - SHINGLE + 1].tolist()
    end = np.concatenate((gap, [len(line)]))[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(start, end, strict=True)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], *, text: str = "text") -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""

    def work(_, own: K.Text) -> dict:
        raw, bounds = own.data.tobytes(), own.offsets.tolist()
        values = [fingerprint(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
        return {"fp": np.array(values, dtype=_U).view(np.int64)}

    return K.map_texts(docs, text, keep, "fp long", work)


def _planes(values: np.ndarray, skip: range) -> list[np.ndarray]:
    """Bit planes of 64-bit values, little-endian within bytes, without some bits."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(values) % 64
    out = []
    for k in range(64):
        if k not in skip:
            plane = np.concatenate((bits[:, k], np.zeros(pad + 64, dtype=np.uint8)))
            out.append(np.packbits(plane, bitorder="little").view("<u8"))
    return out


def _shifted(plane: np.ndarray, d: int, words: int) -> np.ndarray:
    """The plane with place i moved to i - d; zeros come in."""
    whole, part = divmod(d, 64)
    low = plane[whole : whole + words]
    if part == 0:
        got = low
    else:
        high = plane[whole + 1 : whole + 1 + words]
        got = low >> _U(part)
        got[: len(high)] |= high << _U(64 - part)
    return got if len(got) == words else np.concatenate((got, np.zeros(words - len(got), dtype=_U)))


def links(values: np.ndarray, bucket: np.ndarray, skip: range) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within buckets, as positions.

    ``bucket`` is sorted; values that share one agree on the bits in ``skip``.
    """
    n = len(values)
    parent = np.arange(n)
    out_a: list[int] = []
    out_b: list[int] = []
    if n < 2:
        return np.array(out_a, dtype=np.int64), np.array(out_b, dtype=np.int64)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    last = np.repeat(edge[1:], np.diff(edge)) - 1  # last place of each place's bucket
    planes = _planes(values, skip)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for d in range(1, int(np.diff(edge).max())):
        # only as far as some bucket still reaches
        live = np.flatnonzero(last[: n - d] >= np.arange(d, n))
        if not len(live):
            break
        reach = int(live[-1]) + 1
        words = -(-reach // 64)
        mask = np.zeros(words * 64, dtype=np.uint8)
        mask[live] = 1
        over = ~np.packbits(mask, bitorder="little").view("<u8")
        ones, twos = np.zeros(words, dtype=_U), np.zeros(words, dtype=_U)
        for k, plane in enumerate(planes):
            x = plane[:words] ^ _shifted(plane, d, words)
            carry = ones & x
            ones = ones ^ x
            # 3 of the counter (both bits set) is beyond the radius, and stays so
            over = over | (twos & carry)
            twos = twos ^ carry
            over = over | (ones & twos)
            if k % 4 == 3 and (~over).max() == 0:
                break
        else:
            hit = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")[:reach])
            hit = hit[parent[hit] != parent[hit + d]]
            for i in hit.tolist():
                a, b = find(i), find(i + d)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out_a.append(i)
                    out_b.append(i + d)
            if len(hit):
                while (flat := parent[parent]).tolist() != parent.tolist() if n < 64 else not np.array_equal(flat := parent[parent], parent):
                    parent = flat
    return np.array(out_a, dtype=np.int64), np.array(out_b, dtype=np.int64)


def _block_key(i: int):
    first, width = BLOCKS[i]
    return F.expr(f"shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L")


def near_links(distinct: DataFrame, *, most: int = MOST) -> DataFrame:
    """Links (a, b) between ``rep`` ids of distinct fingerprints (fp, rep): a spanning set."""
    keys = F.array(*[F.struct(F.lit(i).alias("block"), _block_key(i).alias("key")) for i in range(3)])
    entries = distinct.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.block", "k.key")
    dealt = entries.repartition("block", "key").sortWithinPartitions("block", "key")
    schema = "a long, b long, fp long, rep long"

    def run(batches):
        held: list[pa.Table] = []
        closed = False  # the held bucket is too large and has been sent on

        def done(table: pa.Table):
            block, key = table["block"].to_numpy(), table["key"].to_numpy()
            fp, rep = table["fp"].to_numpy(), table["rep"].to_numpy()
            size = np.diff(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]), [True]))))
            large = np.repeat(size > most, size)
            few = np.repeat(size > 1, size) & ~large
            for i, (first, width) in enumerate(BLOCKS):
                at = np.flatnonzero(few & (block == i))
                a, b = links(fp[at].view(_U), key[at], range(first, first + width))
                if len(a):
                    yield pair(rep[at][a], rep[at][b])
            if large.any():
                yield pass_on(fp[large], rep[large])

        def pair(a, b):
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], names=["a", "b", "fp", "rep"])

        def pass_on(fp, rep):
            none = pa.nulls(len(fp), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(fp), pa.array(rep)], names=["a", "b", "fp", "rep"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            block, key = table["block"].to_numpy(), table["key"].to_numpy()
            same = (block == block[-1]) & (key == key[-1])
            cut = int(np.argmax(same))  # sorted: the last bucket starts here
            if closed and cut == 0 and len(table) and (block[0], key[0]) == closed:
                yield pass_on(table["fp"].to_numpy(), table["rep"].to_numpy())
                held = [table.slice(len(table))]
                continue
            if closed and (block[0], key[0]) == closed:
                end = int(np.argmax(~((block == closed[0]) & (key == closed[1]))))
                yield pass_on(table["fp"].to_numpy()[:end], table["rep"].to_numpy()[:end])
                table, cut = table.slice(end), cut - end
                block, key = table["block"].to_numpy(), table["key"].to_numpy()
            closed = False
            if cut:
                yield from done(table.slice(0, cut))
            rest = table.slice(cut)
            if len(rest) > most:
                closed = (rest["block"][0].as_py(), rest["key"][0].as_py())
                yield pass_on(rest["fp"].to_numpy(), rest["rep"].to_numpy())
                rest = rest.slice(len(rest))
            held = [rest]
        if held and len(held[0]):
            yield from done(held[0])

    found = materialise(dealt.mapInArrow(run, schema))
    direct = found.where("a is not null").select("a", "b")
    crowded = found.where("fp is not null").select("fp", "rep")
    if crowded.isEmpty():
        return direct
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    near = crowded.distinct().select(F.explode(flips).alias("value"), "rep")
    least = near.groupBy("value").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    # every member of a value is linked to the value's least member
    star = near.join(least, "value").where("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    return direct.unionByName(star.distinct())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is reachable, for every node of ``edges`` (a, b).

    Large-star and small-star rounds over edges kept as (larger, smaller).  Their
    number grows with the logarithm of the longest path, and each round that changes
    anything lowers the sum of the smaller ends, so they end; the state is as large as
    the edge list and is written after each round.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while not now.isEmpty():
        # large star: link the larger neighbours of each node to its least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        # small star: link a node and its smaller neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        other = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        now = materialise(own.unionByName(other).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(
    docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", most: int = MOST
) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``.

    ``component_id`` is the least id reachable over links of at most two differing
    bits.  A text without words (null, empty, blank) has fingerprint zero, linked like
    any other.  Repeated ids stay rows of their own, and texts that share an id are
    linked by their fingerprints only.  A row with a null id gets the component of its
    fingerprint, null if no row there has an id.
    """
    key = K.unused([row_id], "key")
    fps = materialise(fingerprints(docs.select(F.col(row_id).alias(key), F.col(text).alias(K.unused([key], "t"))), [key], text=K.unused([key], "t")))
    found = with_classes(fps, most=most)
    least = found.groupBy("class").agg(F.min(key).alias("component_id"))
    # as many fingerprints as there are, not rows: copies are not dealt by their class
    known = found.select("fp", "class").distinct().join(least, "class").select("fp", "component_id")
    return spread(fps, known).select(F.col(key).alias(row_id), "fp", "component_id")


def classes(fps: DataFrame, *, most: int = MOST) -> DataFrame:
    """(fp, class): the least fingerprint that each distinct one reaches."""
    distinct = fps.groupBy("fp").agg(F.count("*").alias("n")).select("fp", F.col("fp").alias("rep"))
    joined = components(near_links(distinct, most=most).where("a <> b"))
    return distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("class"))


def spread(rows: DataFrame, table: DataFrame, *, share: int = 4096) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``fp`` of theirs.

    Fingerprints that more than one in ``share`` rows have, ``share`` of them at most,
    are sent to all executors, so their rows stay where they are.
    """
    counts = rows.groupBy("fp").agg(F.count("*").alias("_n"))
    every = rows.count()
    hot = table.join(counts.where(F.col("_n") * share > every), "fp", "left_semi")
    names = [c for c in table.columns if c != "fp"]
    sent = hot.select("fp", F.struct(*names).alias("_hot"))
    marked = rows.join(F.broadcast(sent), "fp", "left").withColumn("_deal", F.when(F.col("_hot").isNull(), F.col("fp")))
    # a null key joins nothing; it is dealt by the row's other columns
    rest = table.select(F.col("fp").alias("_fp"), F.struct(*names).alias("_rest"))
    here = marked.where("_hot is not null").select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in names])
    away = marked.where("_hot is null").join(rest, F.col("_deal") == F.col("_fp")).select(*rows.columns, *[F.col("_rest")[c].alias(c) for c in names])
    return here.unionByName(away)


def with_classes(fps: DataFrame, *, most: int = MOST) -> DataFrame:
    """``fps`` with ``class``."""
    return spread(fps, materialise(classes(fps, most=most)))


def op8(spark, sf_dir: str) -> DataFrame:
    """Digest of the contract over all ``documents``."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
