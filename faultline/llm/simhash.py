"""SimHash near-duplicates by multi-index hashing: segment tables, small Hamming balls, full distance checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import NULL_ID, id_or_least, ship, written
from faultline.operators.components import connected_components

SHINGLE, RADIUS, SEED = 3, 3, 42
SEGMENT_BITS = 32  # two segments: at distance 3 or less, one of them differs in at most one bit
COLD = 48  # bucket size up to which links are listed; larger buckets are cut into tiles
TILE = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text's word shingles, repeats included; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) > shingle:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        codes = np.array([xxh64_intdigest(g, SEED) for g in grams], np.uint64)
    else:
        codes = np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(codes), 1 << 15):
        block = codes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(codes)).tobytes(), "big")


def text_key() -> Column:
    """Tells texts apart that share an id; null text is empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc (null id: the smallest), key of the text, and fp, the fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        codes = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
        return pa.array(codes.view(np.int64))

    return docs.select(id_or_least().alias("doc"), text_key().alias("key"), of(F.col("text").cast("string")).alias("fp"))


def _segments(fp: str) -> str:
    low = f"({fp} & {(1 << SEGMENT_BITS) - 1}L)"
    return f"array(struct(0 as seg, {low} as value), struct(1 as seg, shiftrightunsigned({fp}, {SEGMENT_BITS}) as value))"


def tile_forest(members: np.ndarray, probes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) stars over the links between two sets of fingerprints: connectivity in linear output."""
    near = np.empty((len(members), len(probes)), bool)
    for at in range(0, len(members), 256):
        near[at : at + 256] = np.bitwise_count(members[at : at + 256, None] ^ probes[None, :]) <= radius
    left = np.arange(len(members))
    none = len(members)
    while True:
        right = np.where(near, left[:, None], none).min(axis=0) if len(members) else np.zeros(0, np.int64)
        new = np.minimum(left, np.where(near, right[None, :], none).min(axis=1)) if len(probes) else left
        if (new == left).all():
            break
        left = new
    linked = right < none
    node = np.concatenate([members, probes[linked]])
    root = np.concatenate([members[left], members[right[linked]]])
    keep = node != root
    return node[keep], root[keep]


def link_edges(unique: DataFrame) -> DataFrame:
    """(u, v) fingerprint edges whose connectivity equals that of all links at ``RADIUS`` or fewer differing bits.

    Each fingerprint probes, in both segment tables, its own segment value and
    those with one set bit cleared: of two values one bit apart, the larger finds
    the smaller.  Buckets of up to ``COLD`` entries list their verified links;
    larger ones are compared tile against tile, each giving a spanning star.
    Rows that a generator makes are estimated as one each, so joins of segments
    and probes are told to shuffle: broadcast, they would pass the driver whole.
    """
    table = unique.select(F.expr(f"inline({_segments('fp')})"), "fp").select("seg", F.col("value").alias("slot"), "fp")
    sizes = table.groupBy("seg", "slot").agg(F.count(F.lit(1)).alias("n"))
    sized = written(table.join(sizes.hint("merge"), ["seg", "slot"]), "segments")
    lists = sized.where(F.col("n") <= COLD).groupBy("seg", "slot").agg(F.collect_list("fp").alias("members"), F.max("n").alias("n"))
    hot = sized.where(F.col("n") > COLD).groupBy("seg", "slot").agg(F.max("n").alias("n"))
    slots = lists.unionByName(hot.withColumn("members", F.expr("cast(array() as array<bigint>)")))
    flips = "transform(filter(sequence(0, 31), i -> shiftright(s.value, i) & 1 = 1), i -> s.value ^ shiftleft(1L, i))"
    probes = unique.select("fp", F.expr(f"explode({_segments('fp')}) as s"))
    probes = probes.select("fp", F.col("s.seg").alias("seg"), F.expr(f"explode(concat(array(s.value), {flips})) as slot"))
    close = f"bit_count(m ^ fp) <= {RADIUS} and m <> fp"
    met = written(
        probes.join(slots.hint("merge"), ["seg", "slot"]).select(
            "fp", "seg", "slot", "n", F.expr(f"filter(members, m -> {close})").alias("near")
        ).where(f"n > {COLD} or size(near) > 0"),
        "probes",
    )
    listed = met.where(F.col("n") <= COLD).select(F.col("fp").alias("u"), F.explode("near").alias("v"))

    def forest(t: pa.Table) -> pa.Table:
        fp, side = t.column("fp").to_numpy().view(np.uint64), t.column("side").to_numpy()
        node, root = tile_forest(fp[side == 0], fp[side == 1])
        return pa.table({"u": node.view(np.int64), "v": root.view(np.int64)})

    crowd = met.where(F.col("n") > COLD).select("seg", "slot", "fp")
    # Tiles by a hash of the fingerprint; every member tile meets every probe tile of its bucket.
    shape = crowd.groupBy("seg", "slot").agg(F.count(F.lit(1)).alias("p")).join(hot, ["seg", "slot"])
    shape = shape.selectExpr("seg", "slot", f"ceil(n / {TILE}) as a", f"ceil(p / {TILE}) as b")
    members = sized.where(F.col("n") > COLD).select("seg", "slot", "fp").join(shape, ["seg", "slot"])
    members = members.selectExpr("seg", "slot", "fp", "0 as side", "pmod(xxhash64(fp), a) as ta", "explode(sequence(0L, b - 1)) as tb")
    probing = crowd.join(shape, ["seg", "slot"])
    probing = probing.selectExpr("seg", "slot", "fp", "1 as side", "pmod(xxhash64(fp), b) as tb", "explode(sequence(0L, a - 1)) as ta")
    tiles = members.unionByName(probing).groupBy("seg", "slot", "ta", "tb").applyInArrow(forest, "u long, v long")
    return listed.unionByName(tiles)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Fingerprints within ``RADIUS`` bits are linked and links are followed; the
    component's name is its smallest doc_id.  A text without words, empty or
    null, has fingerprint zero and links like any other.  Equal texts share a
    fingerprint, so copies are never compared with each other.  Null ids count
    as the smallest id and a component that holds one is named null; repeated
    rows stay.  Other columns are not read; an empty table gives no rows.
    """
    found = written(fingerprints(docs), "fingerprints")
    of = _named(found).select("fp", F.col("first.doc").alias("component_id"))
    back = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return found.join(of, "fp").select(
        back("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), back("component_id").alias("component_id")
    )


def _named(found: DataFrame) -> DataFrame:
    """fp and the first (doc, key) of its component."""
    unique = written(found.groupBy("fp").agg(F.min(F.struct("doc", "key")).alias("first")), "unique")
    label = connected_components(link_edges(unique.select("fp")))
    named = unique.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    named = written(named.select("fp", "root", "first"), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("fp", "root").join(least, "root").select("fp", "first")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns unchanged: that of the smallest doc_id, null first, then of the least text hash.

    Texts that share an id, or have none, are told apart by their hash; of rows
    with the same id and text, one stays.
    """
    found = written(fingerprints(docs), "fingerprints")
    first = _named(found).select(F.col("first.doc").alias("_a"), F.col("first.key").alias("_b")).distinct()
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], id_or_least().alias("_doc"), text_key().alias("_key"))
    kept = rows.join(first, (F.col("_doc") == F.col("_a")) & (F.col("_key") == F.col("_b")), "left_semi").dropDuplicates(["_doc", "_key"])
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
