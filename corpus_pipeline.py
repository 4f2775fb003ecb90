"""From raw documents to packed training sequences: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.decontaminate import contamination
from barloom.llm.langid import drop_undetermined
from barloom.llm.linededup import dedup_lines
from barloom.llm.neardup import near_duplicates
from barloom.llm.packing import pack
from barloom.llm.queries import WORD_BPE, table
from barloom.llm.work import Workspace, session_of


def _plain(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text named by their places, so that they meet no name that an operator adds."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no language go: null, empty or without a letter. Each row is judged by its own whole text, repeated
    ones too; where no label teaches anything, rows with a letter stay. An empty table gives an empty one."""
    return drop_undetermined(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, alike or within one edit, go; a document left with no line that isn't blank goes too.

    Of equal lines the one of the smallest doc_id and place stays; rows that share a doc_id lose the same lines; null texts stay.
    A column n_chars tells the length of the new text, where there is one; other columns stay, whatever their names.
    """
    plain = _plain(docs)
    out = dedup_lines(plain)
    emptied = (F.col("n_kept") < F.col("n_lines")) & ~F.coalesce(F.col("text").rlike(r"[^ \n]"), F.lit(False))
    out = out.filter(~emptied).select(*plain.columns).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; so does every text without words.

    Of rows that repeat a doc_id and its text one stays; rows of one doc_id with other texts stay with it. A null doc_id stays.
    """
    plain = _plain(docs)
    gone = near_duplicates(plain).filter("not kept").select("doc_id")
    kept = plain.join(gone, "doc_id", "left_anti").select(*plain.columns)
    again = plain.filter("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id").distinct()
    if not again.isEmpty():
        rest = [c for c in plain.columns if c not in ("doc_id", "text")]
        nth = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*rest) if rest else F.lit(0)))
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").withColumn("nth", nth).filter("nth = 1").drop("nth")).select(*plain.columns)
    return kept.toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go, each row judged by its own text; null texts stay, as does all where the benchmark is empty."""
    plain = _plain(docs)
    return contamination(plain, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*plain.columns).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of pack(): every row is packed, null texts as empty ones, repeated rows each; other columns don't matter."""
    return pack(docs.select("doc_id", "text"), WORD_BPE)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each but the last is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(session_of(docs), "pipeline")
    for _, stage in STAGES[:-1]:
        docs = ws.stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The tokenizer's ids are beyond SQL; tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None
