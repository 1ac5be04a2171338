r"""SimHash near-dedup with covering locality-sensitive hashing.

A text's words (ASCII letters lowered, split at ASCII white space) give shingles of four words; each bit of the
64-bit fingerprint is set if it is set in over half of the shingles' XXH64 values. Fingerprints of up to `radius`
differing bits are linked. Candidates come from covering masks: every bit position has a random label of radius + 1
bits, and the table of a nonzero vector v compares the positions whose label has an odd inner product with v. The
labels of `radius` differing positions leave some v orthogonal to all of them, and that v's table sees no difference:
so each pair within the radius meets in one of the 2^(radius+1) - 1 tables, without exception. Distances are then
checked exactly.

Equal fingerprints are one node, whatever the number of copies, and copies get their node's component by a join that
spreads hot fingerprints. Groups of one table's key are compared in blocks of bounded size and give a spanning forest
of their links, never all pairs. Components come from distributed union-find.

Null and empty texts, and texts of white space only, have fingerprint zero, linked as any other. A component's id is
the smallest id in it, ignoring nulls (null if all are null). Repeated rows and repeated ids each keep their row. An
empty table gives an empty result. Only id and text are read, so extra columns can have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, give_back, map_texts, table
from .groups import components, join_one, linked

MOST = 4096  # members of a group that one task compares at a time


def fingerprint(text: str, width: int = 4) -> int:
    """The unsigned 64-bit fingerprint."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n <= width:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = 4, bits: int = 64, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks; each set of `radius` positions is missed altogether by one of them at least.

    Labels are dealt in equal shares and then shuffled, so all tables compare about half of the positions.
    """
    size = radius + 1
    labels = np.random.default_rng(seed).permutation([1 + k % ((1 << size) - 1) for k in range(bits)]).tolist()
    return [sum(1 << k for k, label in enumerate(labels) if (label & v).bit_count() & 1) for v in range(1, 1 << size)]


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long, for every row."""

    def make():
        return lambda batch: {"fp": [signed(fingerprint(x)) for x in batch]}

    return map_texts(df, keep, text_col, "fp long", make)


def links(ws: Workspace, prints: DataFrame, radius: int = 4, most: int = MOST) -> DataFrame:
    """a, b: links between the distinct fingerprints `fp` that connect all within the radius."""
    tables = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("m")) for k, m in enumerate(covering_masks(radius))]
    rows = prints.select("fp", F.explode(F.array(*tables)).alias("x")).select(F.xxhash64("x.t", "x.m").alias("key"), F.col("fp").alias("node"))

    def near_of(group: pa.Table):
        bare = group["node"].to_numpy().view(np.uint64)
        return lambda x, others: np.bitwise_count(bare[x] ^ bare[others]) <= radius

    return linked(ws, rows, near_of, most, "keys")


def near_groups(ws: Workspace, found: DataFrame, id_col: str, radius: int = 4) -> DataFrame:
    """fp, n (its rows), label (the component's smallest fingerprint) and component_id for each fingerprint of
    `found`."""
    prints = ws.store(found.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "prints")
    of = components(ws, links(ws, prints.select("fp"), radius), "components")
    labelled = ws.store(prints.join(of, F.col("fp") == F.col("node"), "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("label")), "labelled")
    least = ws.store(labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    groups = ws.store(join_one(labelled.withColumnRenamed("n", "rows"), least, "label", total).withColumnRenamed("rows", "n"), "groups")
    ws.keep("fingerprints", "groups")
    return groups


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id for every row."""
    ws = Workspace(df.sparkSession, "simhash")
    found = ws.store(fingerprints(df, [id_col], text_col), "fingerprints")
    groups = near_groups(ws, found, id_col, radius).select("fp", "n", "component_id")
    total = groups.agg(F.sum("n")).first()[0] or 0
    return join_one(found, groups, "fp", total).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """The rows of df but for those near an earlier one: of each component the row with the smallest id stays (nulls
    come last; among rows of one id, the smallest by a hash of id and text; of equal rows, one)."""
    from pyspark.sql import Window

    ws = Workspace(df.sparkSession, "simhash")
    inner = [f"c{i}" for i in range(len(df.columns))]
    at, text = (inner[df.columns.index(c)] for c in (id_col, text_col))
    keyed = df.toDF(*inner).withColumns({"k1": F.xxhash64(at, text), "k2": F.xxhash64(text, at)})
    found = ws.store(fingerprints(keyed, [at, "k1", "k2"], text), "fingerprints")
    groups = near_groups(ws, found, at, radius).select("fp", "label")
    order = F.struct(F.col(at).isNull(), at, "k1", "k2").alias("o")
    firsts = found.groupBy("fp").agg(F.min(order).alias("o")).join(groups, "fp").groupBy("label").agg(F.min("o").alias("o"))
    firsts = firsts.select("o.k1", "o.k2")
    one = Window.partitionBy("k1", "k2").orderBy("k1")
    kept = keyed.join(firsts.hint("merge"), ["k1", "k2"]).withColumn("n", F.row_number().over(one)).where("n = 1")
    return kept.select(*inner).toDF(*df.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
