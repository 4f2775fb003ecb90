"""The operators applied to their whole tables, as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.brown import class_model_scores
from barloom.llm.chat import format_turns, masked_text, read_back, turns_of
from barloom.llm.decontaminate import contamination
from barloom.llm.langid import language_of
from barloom.llm.linededup import dedup_lines
from barloom.llm.neardup import near_duplicates
from barloom.llm.packing import pack
from barloom.llm.pii import find_pii
from barloom.llm.quality import quality_scores
from barloom.llm.topk import top_k

#: Folder of the public vocabulary files, the same on every machine.
TOKENIZERS = os.environ.get("BARLOOM_TOKENIZERS", "/opt/tokenizers")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model_scores(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Conversation -1: control strings of a template inside texts.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x"))
    turns = turns_of(table(spark, sf_dir, "conversations")).unionByName(extra.select("conv_id", "x.*"))
    out = format_turns(turns).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_top_k": op3_top_k,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_class_model": op7_class_model,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item, w[i : i + 9] win, len(w[i : i + 9]) n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, w[i : i + n - 1] win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win),
cover AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(len(items), 0) AS BIGINT) n_items,
  sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS reach FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
k AS (SELECT doc_id, min(reach) component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, coalesce(k.component_id, d.doc_id) component_id, coalesce(k.component_id, d.doc_id) = d.doc_id kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) pos, unnest(x) raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) x FROM documents)),
t AS (SELECT doc_id, pos, raw, trim(raw, ' ') line FROM l),
f AS (SELECT line, length(line) n, arg_min(doc_id, (doc_id, pos)) fd, arg_min(pos, (doc_id, pos)) fp FROM t WHERE line <> '' GROUP BY line),
h AS (SELECT line, n, fd, fp, n AS tag, n // 2 AS cut, 0 AS more FROM f WHERE n >= 16 UNION ALL SELECT line, n, fd, fp, n - 1, (n - 1) // 2, 1 FROM f WHERE n >= 16),
q AS (SELECT line, n, fd, fp, tag, more, 'p' side, substr(line, 1, cut) part FROM h UNION ALL SELECT line, n, fd, fp, tag, more, 's', substr(line, cut + more + 1) FROM h),
c AS (SELECT DISTINCT a.line, b.line AS old FROM q a JOIN q b ON a.tag = b.tag AND a.side = b.side AND a.part = b.part AND a.more + b.more < 2 AND (b.fd, b.fp) < (a.fd, a.fp)),
v AS (SELECT DISTINCT line FROM (
  SELECT line, old, unnest(range(1, greatest(length(line), length(old)) + 1)) i FROM c)
  WHERE CASE WHEN length(line) = length(old) THEN substr(line, 1, i - 1) || substr(line, i + 1) = substr(old, 1, i - 1) || substr(old, i + 1)
    WHEN length(line) > length(old) THEN substr(line, 1, i - 1) || substr(line, i + 1) = old ELSE substr(old, 1, i - 1) || substr(old, i + 1) = line END),
k AS (SELECT t.doc_id, t.pos, t.raw, t.line = '' OR (v.line IS NULL AND f.fd = t.doc_id AND f.fp = t.pos) keep FROM t LEFT JOIN f USING (line) LEFT JOIN v USING (line))
SELECT d.doc_id, CAST(CASE WHEN any_value(d.text) IS NULL THEN 0 ELSE count(*) END AS BIGINT) n_lines,
  CAST(CASE WHEN any_value(d.text) IS NULL THEN 0 ELSE count(*) FILTER (keep) END AS BIGINT) n_kept,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (keep), '')) text_sha256
FROM k JOIN documents d USING (doc_id) GROUP BY d.doc_id""",
    "op3_top_k": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) score FROM v q JOIN v c ON q.n <> c.n AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS "rank", vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) r FROM s) WHERE r <= 5""",
    "op10_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') "text" FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length("text") + length(role) + length('<|turn|><|text|><|end|>') + list_sum(list_transform(['\', '<|', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
  lambda c: (length("text") - length(replace("text", c, '')) + length(role) - length(replace(role, c, ''))) // length(c))) n FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) n_turns, sha256(string_agg(role || chr(10) || "text" || chr(10), '' ORDER BY turn, role, "text")) turns_sha256,
  CAST(coalesce(sum(length("text")) FILTER (role = 'assistant'), 0) AS BIGINT) loss_chars, sha256(coalesce(string_agg("text", '' ORDER BY turn, role, "text") FILTER (role = 'assistant'), '')) loss_sha256,
  CAST(sum(n) AS BIGINT) formatted_chars
FROM e GROUP BY conv_id""",
}
