r"""Line dedup: of all lines that are alike over all texts, one stays.

Lines (parts between "\n") are compared in lower case with white space folded. Signatures are one-permutation MinHash
over shingles of `SHINGLE` characters: each shingle falls in one of BANDS x ROWS bins by its hash and each bin keeps
the least; empty bins borrow from bins that a fixed table names. Lines that agree in all bins of a band are
candidates; at a similarity of 0.8 that finds 97 % of pairs, at 0.9 all but 1 in 10,000. Candidate lines are gathered
by candidate components and verified there by the exact Jaccard similarity of their shingle sets; verified links are
joined by distributed union-find, and each component keeps its first line (by id, nulls last, then line number).

Equal lines are one node, whatever their number: a task gives out a line's bands once, and positions are reduced to
the first before they meet. A candidate component of over `MOST` lines, which chance may have chained, is verified
band by band; a band of over `MOST` lines in blocks that share its first line. Both give a spanning forest of links,
never all pairs. To fetch candidate lines' texts, a bit set of fixed size (8 MB) is broadcast
that all candidates are in; what it lets through in vain falls out in the join that follows.

Lines of ASCII white space only are blank: never compared, never dropped. Lines of other white space only are compared
as the empty line, so one stays of all of them. Lines shorter than a shingle are alike only
if equal. Null and empty texts have no lines and come back as they are. Of equal rows (id and text) the first keeps
lines, the others keep none. Lines are told apart by 64-bit hashes of their compared form. Other columns are passed
through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import Workspace, by_bytes, give_back, table
from .groups import components, linked, small

SHINGLE, ROWS, BANDS = 7, 6, 12
BINS = ROWS * BANDS
THRESHOLD = 0.8
MOST = 512  # lines of a group that one task compares at a time
SEEN = 1_000_000
CHUNK = 1 << 20
BLANK = " \t\r\x0b\x0c"
BITS_WORDS = 1 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
STEP, MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(11)
LENDERS = np.stack([_rng.permutation(BINS) for _ in range(64)])  # in round t, bin b borrows from LENDERS[t, b]
WEIGHTS = _rng.integers(1, 1 << 62, BINS, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def compared(line: str) -> str:
    return " ".join(line.lower().split())


def line_hash(form: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(form.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


def shingles(form: str) -> set[str]:
    return {form[i : i + SHINGLE] for i in range(len(form) - SHINGLE + 1)} or {form}


def _parts(forms: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Lines in portions of about CHUNK characters; a longer line in overlapping parts."""
    owners, held, size = [], [], 0
    for k, form in enumerate(forms):
        for at in range(0, max(1, len(form) - SHINGLE + 1), CHUNK):
            part = form if len(form) <= CHUNK else form[at : at + CHUNK + SHINGLE - 1]
            owners.append(k)
            held.append(part)
            size += len(part)
            if size >= CHUNK:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def rolled(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts in a row, each text's length there, and the places of shingles that reach
    over a text's end. A text shorter than a shingle is filled up."""
    padded = [p if len(p) >= SHINGLE else p + "\0" * (SHINGLE - len(p)) for p in parts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    size = len(points) - SHINGLE + 1
    h = points[:size].copy()
    for k in range(1, SHINGLE):
        h *= STEP
        h += points[k : k + size]
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    over = (np.cumsum(lengths)[:-1, None] - np.arange(1, SHINGLE)).ravel()
    return h, lengths, over


def signatures(forms: list[str]) -> np.ndarray:
    """(lines, BINS) least hashes."""
    out = np.full(len(forms) * BINS, NONE)
    for owners, parts in _parts(forms):
        h, lengths, over = rolled(parts)
        slot = np.repeat(np.array(owners, np.int64) * BINS, lengths)[: len(h)]
        slot += (((h >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24)).astype(np.int64)
        h[over] = NONE
        np.minimum.at(out, slot, h)
    found = out.reshape(-1, BINS)
    filled = found.copy()
    row, column = np.nonzero(found == NONE)
    for lenders in LENDERS:
        if not len(row):
            break
        lent = found[row, lenders[column]]
        filled[row, column] = lent
        rest = lent == NONE
        row, column = row[rest], column[rest]
    if len(row):
        filled[row, column] = found[row].min(axis=1)
    return filled


class ShingleSets:
    """The shingle sets of some lines, by 64-bit hashes, laid out so that one line meets many in one step."""

    def __init__(self, forms: list[str]):
        h, lengths, over = rolled(forms)
        line = np.repeat(np.arange(len(forms)), lengths)[: len(h)]
        whole = np.ones(len(h), bool)
        whole[over] = False
        h, line = h[whole], line[whole]
        order = np.lexsort((h, line))
        h, line = h[order], line[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])))
        kinds, self.flat = np.unique(h[first], return_inverse=True)
        self.sizes = np.bincount(line[first], minlength=len(forms))
        self.edge = np.concatenate(([0], np.cumsum(self.sizes)))
        self.mark = np.zeros(len(kinds), bool)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many shingles each of the others shares with x."""
        mine = self.flat[self.edge[x] : self.edge[x + 1]]
        self.mark[mine] = True
        if 8 * len(others) > len(self.sizes):
            out = np.add.reduceat(self.mark[self.flat], self.edge[:-1], dtype=np.int64)[others]
        else:
            out = np.array([np.count_nonzero(self.mark[self.flat[self.edge[y] : self.edge[y + 1]]]) for y in others.tolist()])
        self.mark[mine] = False
        return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """(lines, BANDS) signed keys."""
    keys = (found * WEIGHTS).reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * MIX
    keys ^= keys >> np.uint64(32)
    return (keys * STEP).view(np.int64)


def lines_of(text: str | None) -> Iterator[tuple[int, str]]:
    """Number and compared form of each line that is not blank."""
    for k, line in enumerate((text or "").split("\n")):
        if line.strip(BLANK):
            yield k, compared(line)


def line_rows(keyed: DataFrame) -> DataFrame:
    """k1, k2, line, hash, keys for each line of rows (k1, k2, text); keys are null where a task gave them before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in by_bytes(batches, "text", 1 << 20):
            k1, k2, number, hashes, fresh, forms = [], [], [], [], [], []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
                for k, form in lines_of(text):
                    h = line_hash(form)
                    k1.append(a)
                    k2.append(b)
                    number.append(k)
                    hashes.append(h)
                    fresh.append(h not in seen)
                    if fresh[-1]:
                        seen.add(h)
                        forms.append(form)
                if len(seen) > SEEN:
                    seen.clear()
            keys = band_keys(signatures(forms))
            offsets = np.concatenate(([0], np.cumsum(np.array(fresh, np.int64) * BANDS))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()), mask=pa.array([not x for x in fresh], pa.bool_()))
            columns = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(number, pa.int32()), pa.array(hashes, pa.int64()), lists]
            whole = pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "line", "hash", "keys"])
            for k in range(0, whole.num_rows, 1 << 14):
                yield whole.slice(k, 1 << 14)
        seen.clear()
        give_back()

    return keyed.mapInArrow(run, "k1 long, k2 long, line int, hash long, keys array<long>")


def candidate_links(rows: DataFrame) -> DataFrame:
    """a, b: each line of a band with the band's least line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_before, least_before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, line = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate(([key[0] != key_before], key[1:] != key[:-1]))
            least = line[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            if not new[0]:
                least[: np.argmax(new) if new.any() else len(new)] = least_before
            key_before, least_before = key[-1], least[-1]
            far = line != least
            yield pa.RecordBatch.from_arrays([pa.array(line[far]), pa.array(least[far])], names=["a", "b"])

    banded = rows.where("keys is not null").select(F.explode("keys").alias("key"), "hash")
    return banded.repartition("key").sortWithinPartitions("key", "hash").mapInArrow(run, "a long, b long")


def bit_set(ws: Workspace, nodes: DataFrame) -> np.ndarray:
    """A bit for each node in BITS_WORDS words; their number bounds what comes to the driver."""
    word = F.pmod("node", F.lit(BITS_WORDS)).cast("int")
    rows = nodes.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftright(node, 20), 64) as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS_WORDS, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def candidate_forms(keyed: DataFrame, bits: np.ndarray) -> DataFrame:
    """node, form: the lines whose bit is set."""
    shared = keyed.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = shared.value, set()
        for batch in by_bytes(batches, "text", 1 << 20):
            every = [form for text in batch.column("text").to_pylist() for _, form in lines_of(text)]
            hashes = np.fromiter(map(line_hash, every), np.int64, len(every))
            bit = (held[hashes % BITS_WORDS] >> ((hashes >> 20) % 64).astype(np.uint64)) & np.uint64(1)
            nodes, forms = [], []
            for k in np.flatnonzero(bit).tolist():
                if (h := int(hashes[k])) not in seen:
                    seen.add(h)
                    nodes.append(h)
                    forms.append(every[k])
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(forms, pa.string())], names=["node", "form"])
        seen.clear()
        give_back()

    return keyed.select("text").mapInArrow(run, "node long, form string")


def verified_links(ws: Workspace, gathered: DataFrame, threshold: float, most: int = MOST) -> DataFrame:
    """a, b: links between lines (component, node, form) of one candidate component that share a band and reach the
    threshold. A component of over `most` lines is taken apart into its bands."""

    def near_of(group: pa.Table):
        forms = group["form"].to_pylist()
        keys, sets = band_keys(signatures(forms)), ShingleSets(forms)

        def near(x: int, others: np.ndarray) -> np.ndarray:
            hit = (keys[others] == keys[x]).any(axis=1)
            if hit.any():
                with_band = others[hit]
                common = sets.common(x, with_band)
                hit[hit] = common >= threshold * (sets.sizes[x] + sets.sizes[with_band] - common)
            return hit

        return near

    def bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "form", 1 << 18):
            keys = band_keys(signatures(part.column("form").to_pylist()))
            each = np.repeat(np.arange(len(keys)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("node").take(pa.array(each)), part.column("form").take(pa.array(each))], names=["key", "node", "form"])
        give_back()

    large = ws.store(gathered.groupBy("component").count().where(F.col("count") > most).select("component"), "large")
    n_large = large.count()
    rows = gathered.select(F.col("component").alias("key"), "node", "form")
    if n_large:
        hint = small(large, n_large)
        chained = gathered.join(hint, "component", "left_semi").select("node", "form").mapInArrow(bands, "key long, node long, form string")
        whole = gathered.join(hint, "component", "left_anti").select(F.col("component").alias("key"), "node", "form")
        rows = ws.store(whole.unionByName(chained), "grouped")
    return linked(ws, rows, near_of, most, "lines-alike")


def kept_lines(ws: Workspace, keyed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """k1, k2, kept: numbers of the lines that stay, for the rows (id, k1, k2, text) with any."""
    rows = ws.store(line_rows(keyed.select("k1", "k2", "text")), "lines")
    candidates = ws.store(components(ws, candidate_links(rows), "candidates"), "candidate-components")
    forms = candidate_forms(keyed, bit_set(ws, candidates))
    gathered = ws.store(forms.join(candidates, "node").select("component", "node", "form"), "gathered")
    alike = components(ws, verified_links(ws, gathered, threshold), "alike")
    ids = keyed.select("k1", "k2", F.struct(F.col("id").isNull(), "id", "k1", "k2").alias("o"))
    # one row a text: rows of one key are equal in id and text
    ids = ids.groupBy("k1", "k2").agg(F.min("o").alias("o"))
    place = F.struct("o", "line").alias("first")
    firsts = rows.select("k1", "k2", "line", "hash").join(ids, ["k1", "k2"]).select("hash", place).groupBy("hash").agg(F.min("first").alias("first"))
    firsts = firsts.join(alike, F.col("hash") == F.col("node"), "left").groupBy(F.coalesce("component", "hash").alias("c")).agg(F.min("first").alias("first"))
    return firsts.groupBy("first.o.k1", "first.o.k2").agg(F.collect_list("first.line").alias("kept"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with dropped lines gone from the text, and its columns followed by n_lines and n_kept (lines not blank)."""
    ws = Workspace(df.sparkSession, "line-dedup")
    inner = [f"c{i}" for i in range(len(df.columns))]
    at, text = inner[df.columns.index(id_col)], inner[df.columns.index(text_col)]
    named = df.toDF(*inner)
    named = named.withColumns({"k1": F.xxhash64(at, text), "k2": F.xxhash64(text, at)})
    keyed = named.select(F.col(at).alias("id"), "k1", "k2", F.col(text).alias("text"))
    kept = ws.store(kept_lines(ws, keyed, threshold), "kept")
    ws.keep("kept")
    one = Window.partitionBy("k1", "k2").orderBy("k1")
    joined = named.join(kept.hint("merge"), ["k1", "k2"], "left").withColumn("copy", F.row_number().over(one))
    joined = joined.select(*inner, F.when(F.col("copy") == 1, F.col("kept")).alias("kept"))
    schema = StructType([*(StructField(n, df.schema[c].dataType) for n, c in zip(inner, df.columns, strict=True)), StructField("n_lines", LongType()), StructField("n_kept", LongType())])

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            out, lines, stay = [], [], []
            for old, kept in zip(batch.column(text).to_pylist(), batch.column("kept").to_pylist(), strict=True):
                parts = (old or "").split("\n")
                full = {k for k, x in enumerate(parts) if x.strip(BLANK)}
                keep = full.intersection(kept or ())
                lines.append(len(full))
                stay.append(len(keep))
                out.append(old if len(keep) == len(full) else "\n".join(x for k, x in enumerate(parts) if k in keep or k not in full))
            columns = [pa.array(out, pa.string()) if n == text else batch.column(n) for n in inner]
            arrow = to_arrow_schema(schema)
            columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip([*columns, pa.array(lines, pa.int64()), pa.array(stay, pa.int64())], arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return joined.mapInArrow(rebuild, schema).toDF(*df.columns, "n_lines", "n_kept")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept (lines not blank) and kept_sha256, of the text that stays, for every row."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
