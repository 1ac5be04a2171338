r"""Benchmark decontamination by a distributed positional inverted index.

Words are the runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` with A-Z lowered. The index has a row (row key, position, term)
for each place where a training text has a term that the test set asks for; it is a table in the shared folder.
Phrase search: each window of test words is looked up by its two rarest terms, by counts over all training texts.
The rarest term's positions, moved by its distance to the next one, are intersected with the next one's list, which
leaves places where the window may lie; the text's words there are compared with the window's. Proximity search: places
of a query's rarest term with every other term within `slop` words.

Two terms suffice since the check that follows is exact; a window's remaining lists would be read only to be mostly
thrown away. Windows are told apart by their words, so one that many items share is looked up and compared once; its
items are joined to the rows that it was found in. A text's candidates are places, of a few dozen bytes each, and its
check takes time in proportion to them. Terms of the test set, its windows and their probes are broadcast after a
count, up to a documented size. Beyond it they are joined by shuffle, with the corpus's most frequent words, which are
few by their share, set apart and broadcast. The intersection is keyed by place, so a term that is everywhere or a
passage that is in many texts spreads over all tasks.

Null and empty texts have no words: n_words 0, no hits; null and empty items have no windows. An item of fewer words
than the window, but not none, is one window of them all. Repeated ids and repeated rows are fine: places found under
a row key are checked against each row's own text. A null id is an id like any other. Item ids are compared as strings;
items with equal text are each listed; a null id has no text to list. Extra columns are not read, or passed through. Empty tables give an empty result or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Workspace, table
from .groups import BROADCAST_ROWS, small

# The complement of a word's characters, before letters are lowered.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does that for ASCII texts and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def raw_words(text: Column) -> Column:
    """The words with their capitals; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def words(text: Column) -> Column:
    return raw_words(lowered(text))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """source, item, w: the words of each item that has any; a source is an item's words, whatever its ids."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    return items.select(F.xxhash64("w").alias("source"), "item", "w").distinct()


def windows(items: DataFrame, size: int) -> DataFrame:
    """source, window: the words of each window, joined by blanks, which no word has."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    placed = items.select("source", "w").distinct().select("source", "w", F.explode(starts).alias("at"))
    return placed.select("source", F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("window")).distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("id", "text"))


def postings(ws: Workspace, docs: DataFrame, terms: DataFrame, n_terms: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """row, position, term for each place of one of the terms in keyed texts."""
    places = docs.select("row", F.posexplode(raw_words(F.col("text"))).alias("position", "w")).select("row", "position", lowered(F.col("w")).alias("term"))
    if n_terms <= most:
        return places.join(F.broadcast(terms), "term")
    # words with more than the most-th part of all places are fewer than `most`; of the rest none is hot
    every = ws.store(places.groupBy("term").agg(F.count("*").alias("n")), "words")
    total = every.agg(F.sum("n")).first()[0] or 0
    frequent = every.where(F.col("n") > total / most).select("term")
    common = F.broadcast(frequent.join(terms, "term", "left_semi"))
    rare = places.join(F.broadcast(frequent), "term", "left_anti").join(terms.hint("merge"), "term")
    return places.join(common, "term").unionByName(rare)


def phrase_hits(ws: Workspace, docs: DataFrame, wanted: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """row, window, start: places where a window may stand, docs as by keyed(); wanted: window.

    Rows are few: of those places where the two rarest terms of a window stand rightly.
    """
    few = lambda df, n: F.broadcast(df) if n <= most else df
    wanted = ws.store(wanted.select("window").distinct(), "windows")
    each = wanted.select("window", F.posexplode(F.split("window", " ")).alias("k", "term"))
    vocabulary = ws.store(each.select("term").distinct(), "vocabulary")
    n_terms = vocabulary.count()
    counts = postings(ws, docs, vocabulary, n_terms, most).groupBy("term").agg(F.count("*").alias("n"))
    counted = each.join(few(ws.store(counts, "counts"), n_terms), "term", "left")
    # the rarest place first; a window is looked up by the two rarest of its places
    ranked = F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "term"))), 1, 2)
    probes = counted.groupBy("window").agg(ranked.alias("r"))
    first, second = F.get("r", F.lit(0)), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    probes = ws.store(probes.where(first.n > 0).select("window", first.k.alias("place"), first.term.alias("term"), second.term.alias("other"), (second.k - first.k).alias("gap")), "probes")
    asked = ws.store(probes.select("term").union(probes.select("other")).distinct(), "asked")
    index = ws.store(postings(ws, docs, asked, asked.count(), most), "postings")
    n_probes = probes.count()
    kinds = probes.select("term", "other", "gap").distinct()
    moved = index.join(few(kinds, n_probes), "term").select("row", "position", (F.col("position") + F.col("gap")).alias("p"), "term", "other", "gap")
    met = moved.join(index.select("row", F.col("position").alias("p"), F.col("term").alias("other")), ["row", "p", "other"])
    return met.join(few(probes, n_probes), ["term", "other", "gap"]).select("row", "window", (F.col("position") - F.col("place")).alias("start")).where("start >= 0").distinct()


def _no_names() -> Column:
    return F.expr("cast(array() as array<string>)")


def _checked(ws: Workspace, docs: DataFrame, parts: DataFrame, id_col: str, text_col: str, keep: list[str], most: int) -> DataFrame:
    """k0.. (the kept columns), row, n_words, hits, held (the windows found) for every row."""
    named = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    found = phrase_hits(ws, named.select("id", "text", "row"), parts, most)
    by_row = ws.store(found, "places").groupBy("row").agg(F.collect_list(F.struct("window", "start")).alias("c"))
    # places grow with the texts, so at no size are they broadcast
    full = named.join(by_row.hint("merge"), "row", "left").withColumn("words", words(F.col("text")))
    size = lambda c: F.size(F.split(c.window, " "))
    real = F.when(F.col("c").isNotNull(), F.filter("c", lambda c: F.array_join(F.slice("words", c.start + 1, size(c)), " ") == c.window))
    out = full.select(*[f"k{i}" for i in range(len(keep))], "row", F.size("words").cast("long").alias("n_words"), real.alias("x"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda c: F.sequence(c.start, c.start + size(c) - 1)))))
    held = F.coalesce(F.array_distinct(F.transform("x", lambda c: c.window)), _no_names())
    return out.select(*out.columns[:-1], F.coalesce(F.when(F.size("x") > 0, places), F.expr("cast(array() as array<int>)")).alias("hits"), held.alias("held"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most: int = BROADCAST_ROWS,
) -> DataFrame:
    """For every row: id, n_words, hits (places of words within a window's occurrence, sorted), items (ids of items
    with occurring windows, sorted as strings)."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    items = ws.store(items_of(benchmark, item_col, item_text_col), "items")
    parts = ws.store(windows(items, size), "item-windows")
    out = ws.store(_checked(ws, docs, parts, id_col, text_col, [id_col], most), "checked")
    ws.keep("items", "item-windows", "checked")
    # only rows with hits meet the items; texts of one key are equal, so their windows are as well
    n_parts = parts.count()
    few = lambda df: F.broadcast(df) if n_parts <= most else df
    held = out.where(F.size("held") > 0).select("row", F.explode("held").alias("window")).distinct()
    of = held.join(few(parts), "window").select("row", "source").distinct().join(few(items.select("source", "item")), "source")
    listed = of.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    dirty = out.where(F.size("held") > 0).join(listed.hint("merge"), "row", "left")
    columns = [F.col("k0").alias(id_col), "n_words", "hits"]
    clean_rows = out.where(F.size("held") == 0).select(*columns, _no_names().alias("items"))
    return dirty.select(*columns, F.coalesce("items", _no_names()).alias("items")).unionByName(clean_rows)


def proximity_hits(docs: DataFrame, queries: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, query, position of the rarest term, for each place where all other terms stand within `slop` words of it.

    queries: query, text. A term asked for twice counts once. Repeated rows of one id and text give one row each place.
    """
    ws = Workspace(docs.sparkSession, "proximity")
    texts = keyed(docs, id_col, text_col)
    asked = ws.store(queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("term")), "asked")
    terms = asked.select("term").distinct()
    n = terms.count()
    index = ws.store(postings(ws, texts, terms, n).distinct(), "postings")
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    ranked = asked.join(counts, "term", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).term.alias("rarest"), F.count("*").alias("n_terms"))
    bucket = lambda c: F.floor(c / (slop + 1))
    anchors = index.join(ranked, F.col("term") == F.col("rarest")).select("row", "query", "n_terms", "rarest", F.col("position").alias("at"))
    near = anchors.select("*", F.explode(F.array(*[bucket(F.col("at")) + d for d in (-1, 0, 1)])).alias("b"))
    others = index.join(asked, "term").select("row", "query", "term", "position", bucket(F.col("position")).alias("b"))
    met = near.join(others, ["row", "query", "b"]).where(F.abs(F.col("at") - F.col("position")) <= slop)
    whole = met.groupBy("row", "query", "at", "n_terms").agg(F.countDistinct("term").alias("met")).where("met = n_terms")
    return texts.select("row", "id").distinct().join(whole, "row").select(F.col("id").alias(id_col), "query", F.col("at").alias("position"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a window of the benchmark, each judged by its own text."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    inner = [f"d{i}" for i in range(len(docs.columns))]
    at, text = (inner[docs.columns.index(c)] for c in (id_col, text_col))
    parts = ws.store(windows(items_of(benchmark), size), "item-windows")
    state = _checked(ws, docs.toDF(*inner), parts, at, text, inner, BROADCAST_ROWS)
    ws.keep("places")
    return state.where(F.size("held") == 0).select(*[f"k{i}" for i in range(len(inner))]).toDF(*docs.columns)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
