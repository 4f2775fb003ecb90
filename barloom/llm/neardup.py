"""MinHash near-duplicate detection with tensored banding.

Each shingle set gets two small collections, A and B, of BANDS keys of ROWS min-hashes each. A table's key is a pair
(A_i, B_j), so BANDS * BANDS tables of 2 * ROWS rows come from 2 * BANDS * ROWS min-hashes, about the square root of what
independent tables would need. At a similarity of 0.75 a pair meets in at least one table with probability
(1 - (1 - 0.75**ROWS)**BANDS)**2 = 0.9999.

Equal sets are merged first. In each table key, members are compared with one hub only (a star, so no
group is expanded into pairs). What a star can't decide is settled exactly: members outside the component of the hub are
compared with the other members, except where a bound rules a link out: the triangle inequality of the Jaccard distance, or
shingles that no other set in question has, which no intersection can hold. The hub is the member that shares most keys, so
that of an original and its copies the original is the hub. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import connected_components, merged
from barloom.llm.words import WordHashes, hashes_of, mix, odd_numbers, shingle_set, words_of
from barloom.llm.work import Workspace, map_batches, session_of

SHINGLE, BANDS, ROWS = 5, 12, 2
#: A link: PERCENT_OF * intersection >= PERCENT * union.
PERCENT, PERCENT_OF = 75, 100
_U = np.uint64
#: Shingles that are min-hashed at once.
_CHUNK = 16_384
#: Pairs of one set, and members of one table key, that go to one task; more are dealt out, with a copy of the set's text for each part.
HUB_PAIRS, KEY_MEMBERS = 256, 512
#: Sets with more pairs than that, 16 bytes each, are broadcast up to this many; beyond it, they are joined by shuffle.
BROADCAST_HUBS = 200_000


def _band_keys(s: np.ndarray, a: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """2 * BANDS keys, of collection A and then of B."""
    low = np.full(len(a), ~_U(0), _U)
    for k in range(0, len(s), _CHUNK):
        low = np.minimum(low, mix_rows(s[k : k + _CHUNK], a).min(axis=0))
    rows = low.reshape(2 * BANDS, ROWS)
    key = salt.copy()
    for r in range(ROWS):
        key = mix(key ^ rows[:, r])
    return key


def mix_rows(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    x = np.multiply.outer(s, a)
    return x ^ (x >> _U(29))


def _features():
    cache, a, salt = WordHashes(), odd_numbers(2 * BANDS * ROWS, 5), odd_numbers(2 * BANDS, 6)

    def run(doc_ids: list, texts: list, text_keys: list) -> tuple:
        n, hi, lo, first, second = [], [], [], [], []
        for text in texts:
            s = shingle_set(hashes_of(words_of(text), cache), SHINGLE)
            n.append(len(s))
            if len(s):
                digest, keys = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64), _band_keys(s, a, salt).view(np.int64)
                hi.append(int(digest[0]))
                lo.append(int(digest[1]))
                first.append(keys[:BANDS])
                second.append(keys[BANDS:])
            else:
                for x, empty in ((hi, 0), (lo, 0), (first, None), (second, None)):
                    x.append(empty)
        return doc_ids, n, hi, lo, first, second, text_keys

    return run


def _jaccard():
    cache = WordHashes()
    last, base = None, np.empty(0, _U)

    def run(xs: list, ys: list, texts_x: list, texts_y: list) -> tuple:
        nonlocal last, base
        both, either = [], []
        for x, text_x, text_y in zip(xs, texts_x, texts_y):
            if x != last:
                last, base = x, shingle_set(hashes_of(words_of(text_x), cache), SHINGLE)
            other = shingle_set(hashes_of(words_of(text_y), cache), SHINGLE)
            total = len(base) + len(other)
            merged = np.sort(np.concatenate((base, other)), kind="stable")
            same = int((merged[1:] == merged[:-1]).sum())
            both.append(same)
            either.append(total - same)
        return xs, ys, both, either

    return run


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of wanted(node): the text of one document that has the node's set."""
    at = nodes.select("node", "doc_id", "text_key").join(wanted, "node", "left_semi")
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return text.join(at, ["doc_id", "text_key"]).dropDuplicates(["node"]).select("node", "text")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, ws: Workspace) -> DataFrame:
    """(x, y, both, any) of stashed pairs(x, y) of nodes: sizes of the intersection and the union of their full sets."""
    texts = _texts(pairs.select(F.col("y").alias("node")).unionByName(pairs.select(F.col("x").alias("node"))).distinct(), nodes, docs)
    hubs = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("parts")).filter("parts > 1")
    hubs = ws.stash(hubs)
    hubs = F.broadcast(hubs) if hubs.count() <= BROADCAST_HUBS else hubs
    dealt = pairs.join(hubs, "x", "left").select("x", "y", F.coalesce(F.pmod(F.xxhash64("y"), "parts"), F.lit(0)).alias("part"))
    copies = texts.withColumnRenamed("node", "x").join(hubs, "x", "left").select("x", F.col("text").alias("text_x"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = dealt.join(texts.select(F.col("node").alias("y"), F.col("text").alias("text_y")), "y").join(copies, ["x", "part"])
    return map_batches(both.select("x", "y", "text_x", "text_y"), _jaccard, "x long, y long, both long, any long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text); other columns are ignored.

    Words are runs without ASCII white space, A-Z lower-cased. Documents are linked where 100 * intersection >=
    75 * union of their 5-word shingle sets (fewer than five words: the whole sequence is the one shingle). component_id is
    the smallest doc_id that links reach, kept is doc_id = component_id. Null or blank texts have no shingles and link with
    nothing. Rows that share a doc_id share a component. A null doc_id has a null component and is kept. No rows, no result.
    """
    ws = Workspace(session_of(docs), "neardup")
    docs = docs.select("doc_id", "text")
    rows = ws.stash(map_batches(docs.select("doc_id", "text", F.xxhash64("text")), _features, "doc_id long, n_shingles long, hi long, lo long, a array<long>, b array<long>, text_key long"))
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy("hi", "lo").agg(F.min_by(F.struct("doc_id", "text_key", "n_shingles", "a", "b"), F.struct("doc_id", "text_key")).alias("x"))
    nodes = ws.stash(nodes.select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "x.*"))

    def shared(side: str) -> DataFrame:
        keyed = nodes.select("node", F.posexplode(side).alias("i", "k"))
        many = keyed.groupBy("i", "k").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
        return keyed.join(many, ["i", "k"]).groupBy("node").agg(F.collect_list(F.struct("i", "k")).alias(side), F.sum("many").alias(f"{side}_degree"))

    table = shared("a").join(shared("b"), "node").join(nodes.select("node", "n_shingles"), "node").withColumn("order", -(F.col("a_degree") + F.col("b_degree")))
    own = ("node", "order", "n_shingles")
    table = ws.stash(table.select(*own, F.explode("a").alias("p"), "b").select(*own, "p", F.explode("b").alias("q")).select(*own, F.col("p.i").alias("i"), F.col("q.i").alias("j"), F.xxhash64("p.i", "p.k", "q.i", "q.k").alias("key")))
    hubs = table.groupBy("key").agg(F.min(F.struct("order", "node", "n_shingles")).alias("hub"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = table.join(hubs, "key").select("key", "i", "j", "node", "n_shingles", F.col("hub.node").alias("hub"), F.col("hub.n_shingles").alias("hub_n"))
    fits = lambda m, n: PERCENT_OF * F.least(m, n) >= PERCENT * F.greatest(m, n)
    stars = members.filter("node <> hub").filter(fits(F.col("n_shingles"), F.col("hub_n"))).select(F.col("hub").alias("x"), F.col("node").alias("y")).distinct()
    tested = ws.stash(_verified(ws.stash(stars), nodes, docs, ws))
    linked = tested.filter(f"{PERCENT_OF} * both >= {PERCENT} * any").select(F.col("x").alias("src"), F.col("y").alias("dst"))
    comps = connected_components(linked, ws)
    more = ws.stash(_undecided(members, tested, comps, nodes, docs, ws))
    again = more.select(F.col("x").alias("src"), F.col("y").alias("dst"))
    if not more.isEmpty():
        again = _verified(more, nodes, docs, ws).filter(f"{PERCENT_OF} * both >= {PERCENT} * any").select(F.col("x").alias("src"), F.col("y").alias("dst"))

    owner = full.select("doc_id", "hi", "lo").join(nodes.select("hi", "lo", "node"), ["hi", "lo"])
    split = owner.groupBy("doc_id").agg(F.min("node").alias("src"), F.max("node").alias("top")).filter("src < top").select("doc_id", "src")
    same_id = owner.join(split, "doc_id").select("src", F.col("node").alias("dst"))
    comps = merged(comps, again.unionByName(same_id), ws)
    named = nodes.select("node", "hi", "lo", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    class_of = ws.stash(named.join(low, "comp").select("hi", "lo", "component_id"))
    out = rows.select("doc_id", "n_shingles", "hi", "lo").join(class_of, ["hi", "lo"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def _shingles():
    cache = WordHashes()

    def run(nodes: list, texts: list) -> tuple:
        sets = [shingle_set(hashes_of(words_of(t), cache), SHINGLE) for t in texts]
        return np.repeat(np.array(nodes, np.int64), [len(s) for s in sets]), np.concatenate([np.empty(0, _U), *sets]).view(np.int64)

    return run


def _undecided(members: DataFrame, tested: DataFrame, comps: DataFrame, nodes: DataFrame, docs: DataFrame, ws: Workspace) -> DataFrame:
    """(x, y), x < y: pairs that meet in a table key, lie in different components, and that no bound rules out."""
    comp = lambda as_: comps.select(F.col("node").alias(as_), F.col("comp").alias(f"{as_}_comp"))
    m = members.join(comp("node"), "node", "left").join(comp("hub"), "hub", "left")
    m = m.withColumn("c", F.coalesce("node_comp", "node")).withColumn("outside", F.col("c") != F.coalesce("hub_comp", "hub"))
    open_keys = m.groupBy("key").agg(F.max("outside").alias("outside"), F.count(F.lit(1)).alias("many"), F.min("n_shingles").alias("least")).filter("outside and many > 2").select("key", "least", F.ceil(F.col("many") / KEY_MEMBERS).alias("parts"))
    dist = tested.select(F.col("x").alias("hub"), F.col("y").alias("node"), (1 - F.col("both") / F.col("any")).alias("far"), "both")
    m = m.join(open_keys, "key")
    asked = ws.stash(m.select("node").distinct())
    m = m.filter("node <> hub").join(dist, ["hub", "node"], "left").withColumn("far_least", F.coalesce("far", 1 - F.least("n_shingles", "hub_n") / F.greatest("n_shingles", "hub_n")))
    m = ws.stash(m.select("key", "i", "j", "node", "n_shingles", "c", "far", "far_least", "outside", "least", "both", "hub_n", "parts"))
    # Shingles that only one of the sets in question has: they count in a union, never in an intersection.
    found = map_batches(_texts(asked, nodes, docs), _shingles, "node long, shingle long")
    alone = found.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("many")).filter("many = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    alone = ws.stash(alone)
    m = m.join(alone, "node", "left").withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))
    # Of what may be common, the part inside the hub's set and the part outside; single shingles aren't in the hub's set.
    m = m.withColumn("within", F.coalesce("both", F.least("common", "hub_n"))).withColumn("beyond", F.coalesce(F.col("common") - F.col("both"), F.col("common")))
    # A pair meets in many keys; it is taken up in the first one, by the places where the keys of both collections agree first.
    m = m.join(nodes.select("node", "a", "b"), "node")
    first = lambda side: F.array_position(F.zip_with(f"a.{side}", f"b.{side}", lambda x, y: x == y), True) - 1
    once = (first("a") == F.col("a.i")) & (first("b") == F.col("a.j"))
    can = lambda both, n, other: PERCENT_OF * both >= PERCENT * (n + other - both)
    a = m.filter("outside").filter(can(F.col("common"), F.col("n_shingles"), F.greatest("least", "common"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("a")
    b = m.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).alias("b")
    limit = 1 - PERCENT / PERCENT_OF + 1e-9
    near = (F.coalesce(F.abs(F.col("a.far") - F.col("b.far")), F.lit(0.0)) <= limit) & (F.coalesce(F.col("a.far_least") - F.col("b.far"), F.lit(0.0)) <= limit) & (F.coalesce(F.col("b.far_least") - F.col("a.far"), F.lit(0.0)) <= limit)
    both = F.least(F.least("a.common", "b.common"), F.least("a.within", "b.within") + F.least("a.beyond", "b.beyond"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.c") != F.col("b.c")) & can(both, F.col("a.n_shingles"), F.col("b.n_shingles")) & near & once)
    pairs = pairs.select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct()
    return pairs.join(tested.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
