"""Near-duplicate line removal by a deletion-neighbourhood join. DataFrame functions only.

Two lines are near when one character inserted, deleted or replaced turns one into the other. Equal lines are merged
first. For the others the neighbourhood is walked from coarse to fine, which loses nothing: a single edit lies in one
block of the line, so the line without that block is the same on both sides. Lines are keyed by what is left without one
of 2 halves, lines that share such a key by what is left without one of BLOCKS blocks, and only inside a shared block are
all one-character deletions emitted as hashed keys, joined, and verified with the edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.work import Workspace, column, session_of

BLOCKS = 16
#: Shorter lines are compared exactly: in a few characters, one edit is a different line.
MIN_NEAR_CHARS = 16
#: Lines that share a half with another, 40 bytes each, are broadcast to the texts up to this many; beyond it, texts are shuffled to them.
BROADCAST_LINES = 1_000_000


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): trimmed lines that are not blank."""
    return (
        docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
        .select("doc_id", "pos", F.trim("raw").alias("line"))
        .filter("line != ''")
        .select("doc_id", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"))
    )


def _bounds(n: Column, k: Column, blocks: int) -> tuple[Column, Column]:
    """First place (from 0) of block k, and of the next, in a line of n characters."""
    return F.floor(n * k / blocks).cast("int"), F.floor(n * (k + 1) / blocks).cast("int")


def _rest_key(line: Column, n: Column, k: Column, blocks: int, longer: int) -> Column:
    """Hash of a line without its block k, cut as in a line of n characters; longer: characters that the block has besides."""
    a, b = _bounds(n, k, blocks)
    b = b + F.lit(longer)
    return F.xxhash64(n, k, F.substring(line, F.lit(1), a), F.lit("\x00"), F.substring(line, b + 1, F.lit(2**31 - 1)))


def _rest_keys(line: Column, n: Column, blocks: int) -> Column:
    """Array of (key, k, longer): the line as one of n characters, and as one that is a character longer than its twin."""
    ks = F.sequence(F.lit(0), F.lit(blocks - 1))
    own = F.transform(ks, lambda k: F.struct(_rest_key(line, n, k, blocks, 0).alias("key"), k.alias("k"), F.lit(0).alias("longer")))
    twin = F.transform(ks, lambda k: F.struct(_rest_key(line, n - 1, k, blocks, 1).alias("key"), k.alias("k"), F.lit(1).alias("longer")))
    return F.concat(own, twin)


def _shared(keyed: DataFrame, on: str) -> DataFrame:
    """Keys that more than one line has."""
    return keyed.groupBy(on).agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select(on)


def dropped_lines(docs: DataFrame, ws: Workspace, min_near_chars: int = MIN_NEAR_CHARS) -> DataFrame:
    """(doc_id, pos, h1) of every line with an equal or near line earlier, in the order of (doc_id, pos); null ids come last."""
    lines = _lines(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos")
    n = F.char_length("line")
    halves = F.when(n >= min_near_chars, F.transform(_rest_keys(F.col("line"), n, 2), lambda x: x["key"]))
    first = ws.stash(lines.select("h1", "h2", order.alias("at"), halves.alias("halves")).groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"), F.first("halves").alias("halves")))
    keyed = first.select("h1", "h2", F.explode("halves").alias("key"))
    coarse = keyed.join(_shared(keyed, "key"), "key", "left_semi").select("h1", "h2").distinct()
    coarse = ws.stash(coarse.join(first.select("h1", "h2", "at"), ["h1", "h2"]).select("h1", "h2", "at"))
    fine = (
        lines.join(F.broadcast(coarse) if coarse.count() <= BROADCAST_LINES else coarse, ["h1", "h2"])
        .filter(F.col("at.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("at.pos") == F.col("pos")))
        .dropDuplicates(["h1", "h2"])
        .select("h1", "h2", "at", "line", n.alias("n"))
        .select("h1", "h2", "at", "line", "n", F.explode(_rest_keys(F.col("line"), F.col("n"), BLOCKS)).alias("x"))
    )
    a, b = _bounds(F.col("n") - F.col("x.longer"), F.col("x.k"), BLOCKS)
    fine = ws.stash(fine.select("h1", "h2", "at", F.col("x.key").alias("key"), F.col("x.longer").alias("longer"), F.substring("line", a + 1, b - a + F.col("x.longer")).alias("block")))
    fine = fine.join(_shared(fine, "key"), "key", "left_semi")
    size = F.char_length("block")
    cut = F.transform(
        F.sequence(F.lit(1), size),
        lambda p: F.xxhash64(F.col("key"), F.when(F.col("longer") == 0, p).otherwise(F.lit(0)), F.concat(F.substring(F.col("block"), F.lit(1), p - 1), F.substring(F.col("block"), p + 1, F.lit(2**31 - 1)))),
    )
    whole = F.array(F.xxhash64(F.col("key"), F.lit(0), F.col("block")))
    shorter = F.when(F.col("longer") == 0, F.concat(whole, F.when(size > 0, cut).otherwise(F.array().cast("array<bigint>")))).otherwise(F.when(size > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<bigint>")))
    variants = ws.stash(fine.select("h1", "h2", "at", "block", "longer", F.explode(shorter).alias("variant")))
    of = lambda longer: F.when(F.col("longer") == longer, F.struct("at", "block"))
    low = variants.groupBy("variant").agg(F.min(of(0)).alias("own"), F.min(of(1)).alias("twin"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    earlier = lambda x: (F.col(f"{x}.at") < F.col("at")) & (F.levenshtein("block", F.col(f"{x}.block"), 1) >= 0)
    near = variants.join(low, "variant").filter(earlier("own") | ((F.col("longer") == 0) & earlier("twin"))).select("h1", "h2").distinct().withColumn("near", F.lit(True))
    told = ws.stash(first.select("h1", "h2", "at", "copies").join(near, ["h1", "h2"], "left").filter("near or copies > 1"))
    drop = lines.select("doc_id", "pos", "h1", "h2", order.alias("here")).join(told, ["h1", "h2"]).filter("near or here > at")
    return drop.select("doc_id", "pos", "h1")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, wherever the optimizer puts the expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines that stay: those of `gone` (pos, h1; by place) that this text has part it into stretches, which are copied whole."""
    here = lambda x: F.transform(F.filter(gone, lambda g: (g["pos"] < F.size(x)) & (F.xxhash64(F.trim(F.get(x, g["pos"]))) == g["h1"])), lambda g: g["pos"])
    edges = lambda x: F.concat(F.array(F.lit(-1)), here(x), F.array(F.size(x)))
    stretch = lambda x, e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.slice(x, F.get(e, k - 1) + 2, F.get(e, k) - F.get(e, k - 1) - 1))
    return F.when(gone.isNull(), lines).otherwise(_let(lines, lambda x: _let(edges(x), lambda e: F.flatten(stretch(x, e)))))


def dedup_lines(docs: DataFrame, min_near_chars: int = MIN_NEAR_CHARS) -> DataFrame:
    """docs with text rebuilt from the lines it keeps, and n_lines, n_kept (blank lines are kept and counted).

    A line goes if an equal line, or one within one edit (both of min_near_chars or more characters, after trimming
    spaces), stands earlier in the order of doc_id and place; so the earliest of each stays. Null text stays null with 0
    lines; rows that share a doc_id are taken as one document and lose the same lines; an empty table gives an empty one.
    The added columns are n_lines and n_kept; columns of docs with these names are replaced, all others stay.
    """
    ws = Workspace(session_of(docs), "lines")
    gone = dropped_lines(docs.select("doc_id", "text"), ws, min_near_chars).groupBy(F.col("doc_id").alias("gone_id")).agg(F.array_sort(F.collect_set(F.struct("pos", "h1"))).alias("gone"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    both = docs.select(F.struct(*[column(c).alias(c) for c in keep]).alias("doc")).join(gone, F.col("doc.doc_id").eqNullSafe(F.col("gone_id")), "left")
    both = both.select("doc", _kept(F.split(F.col("doc.text"), "\n"), F.col("gone")).alias("kept_lines"), F.size(F.split(F.col("doc.text"), "\n")).alias("n"))
    out = [F.when(F.col("doc.text").isNotNull(), F.array_join("kept_lines", "\n")).alias(c) if c == "text" else column(c, "doc").alias(c) for c in keep]
    count = lambda x: F.when(F.col("doc.text").isNull(), F.lit(0)).otherwise(x).cast("long")
    return both.select(*out, count(F.col("n")).alias("n_lines"), count(F.size("kept_lines")).alias("n_kept"))
