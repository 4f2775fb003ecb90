"""Benchmark decontamination with a positional inverted index. DataFrame functions only.

The index holds (term, doc_id, positions) of the terms that a test needs. For every window of a benchmark item the two
terms that are rarest in the corpus are looked up, their position lists are shifted by the terms' distance in the window and
intersected, and what is left is checked word by word in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.work import Workspace, column, session_of

WINDOW = 10
#: What stands between words, once A-Z are lower-cased: all of ASCII but digits and a-z. Splitting takes a fifth of the time of matching words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of terms or windows is broadcast up to this many rows (about 100 bytes each); beyond it, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    lower = F.when(text.rlike("[A-Z]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)
    return F.coalesce(F.array_remove(F.split(lower, BETWEEN), ""), F.array().cast("array<string>"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def positional_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, positions ascending from 0) of docs(doc_id, text), of the given terms(term) or of all."""
    at = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        at = at.join(terms, "term", "left_semi")
    return at.groupBy("term", "doc_id").agg(F.array_sort(F.collect_set("pos")).alias("positions"))


def windows_of(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window, words, items): distinct windows of width words with the ids, as strings, of the items that have them."""
    t = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), tokens(F.col("text")).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    w = t.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("words"))
    return w.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.xxhash64("words").alias("window"), "words", "items")


def _anchors(docs: DataFrame, windows: DataFrame, ws: Workspace) -> DataFrame:
    """windows with first, second (terms), shift (of the second from the first) and offset (of the first): the two rarest terms."""
    vocab = ws.stash(windows.select(F.explode("words").alias("term")).distinct())
    seen = docs.select(F.explode(tokens(F.col("text"))).alias("term")).join(_sized(vocab, vocab.count()), "term", "left_semi")
    freq = seen.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    placed = windows.select("window", F.posexplode("words").alias("at", "term")).groupBy("window", "term").agg(F.min("at").alias("at"))
    ranked = placed.join(freq, "term", "left").groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "term", "at"))).alias("rare"))
    one, two = F.col("rare")[0], F.coalesce(F.try_element_at("rare", F.lit(2)), F.col("rare")[0])
    ranked = ranked.filter(one["freq"] > 0)
    return windows.join(ranked, "window").select("window", "words", "items", one["term"].alias("first"), two["term"].alias("second"), (two["at"] - one["at"]).alias("shift"), one["at"].alias("offset"))


def _candidates(docs: DataFrame, benchmark: DataFrame, width: int, slop: int, ws: Workspace) -> DataFrame:
    """(cand_id, cands): for documents with both anchors of a window in place, its (start, len, window, words if slop, items)."""
    windows = ws.stash(_anchors(docs, ws.stash(windows_of(benchmark, width)), ws))
    pairs = windows.select("first", "second", "shift").distinct()
    n = windows.count()
    terms = pairs.select(F.explode(F.array("first", "second")).alias("term")).distinct()
    index = ws.stash(positional_index(docs, _sized(terms, 2 * n)))
    pairs = _sized(pairs, n)
    first = index.join(pairs, F.col("term") == F.col("first")).select("first", "second", "shift", "doc_id", F.col("positions").alias("here"))
    second = index.join(pairs, F.col("term") == F.col("second")).select("first", "second", "shift", F.col("doc_id").alias("doc_2"), F.transform("positions", lambda p: p - F.col("shift")).alias("there"))
    if slop:
        common = F.filter("here", lambda p: F.exists("there", lambda q: F.abs(p - q) <= slop))
    else:
        common = F.array_intersect("here", "there")
    met = first.alias("l").join(second.alias("r"), (F.col("l.first") == F.col("r.first")) & (F.col("l.second") == F.col("r.second")) & (F.col("l.shift") == F.col("r.shift")) & F.col("doc_id").eqNullSafe(F.col("doc_2")))
    met = met.select("l.first", "l.second", "l.shift", "doc_id", F.explode(common).alias("pos"))
    w = _sized(windows, n)
    cand = F.struct((F.col("pos") - F.col("offset")).alias("start"), F.size("words").alias("len"), "window", F.when(F.lit(slop > 0), F.col("words")).alias("words"), "items")
    return met.join(w, ["first", "second", "shift"]).groupBy(F.col("doc_id").alias("cand_id")).agg(F.collect_list(cand).alias("cands"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, share: float = 0.8) -> DataFrame:
    """docs with n_words, n_hit, hit_items (sorted ids as strings), hits (start, len, items of each occurrence) and contaminated.

    slop 0: a word is hit inside any exact occurrence of a window of width words (a shorter item is one window). slop > 0:
    proximity; a window also occurs where its two rarest terms stand within slop words of their places and at least the given
    share of its distinct words lies within slop words around. Null texts have no words; items without words or with a null id
    have no windows; rows that share a doc_id are judged each on its own text; empty tables give 0 hits, or no rows. The added
    columns replace columns of these names.
    """
    ws = Workspace(session_of(docs), "decontaminate")
    cands = _candidates(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), width, slop, ws)
    added = ("n_words", "n_hit", "hit_items", "hits", "contaminated")
    keep = [c for c in docs.columns if c not in added]
    both = docs.select(F.struct(*[column(c).alias(c) for c in keep]).alias("doc")).join(cands, F.col("doc.doc_id").eqNullSafe(F.col("cand_id")), "left")
    both = both.select("doc", "cands", tokens(F.col("doc.text")).alias("tokens"))
    if slop:
        inside = lambda c: F.slice("tokens", F.greatest(c["start"] - slop, F.lit(0)) + 1, c["len"] + 2 * slop)
        real = lambda c: F.size(F.array_intersect(c["words"], inside(c))) >= F.ceil(share * F.size(F.array_distinct(c["words"])))
    else:
        real = lambda c: (c["start"] >= 0) & (F.xxhash64(F.slice("tokens", c["start"] + 1, c["len"])) == c["window"])
    both = both.select("doc", F.size("tokens").alias("n"), F.when(F.col("cands").isNotNull(), F.filter("cands", real)).alias("real"))
    covered = F.transform("real", lambda c: F.sequence(F.greatest(c["start"], F.lit(0)), F.least(c["start"] + c["len"], F.col("n")) - 1))
    n_hit = F.coalesce(F.when(F.size("real") > 0, F.size(F.array_distinct(F.flatten(covered)))), F.lit(0)).cast("long")
    items = F.coalesce(F.when(F.size("real") > 0, F.array_sort(F.array_distinct(F.flatten(F.transform("real", lambda c: c["items"]))))), F.array().cast("array<string>"))
    hits = F.coalesce(F.transform("real", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["items"].alias("items"))), F.array().cast("array<struct<start:int,len:int,items:array<string>>>"))
    out = both.select(*[column(c, "doc").alias(c) for c in keep], F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), items.alias("hit_items"), hits.alias("hits"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
