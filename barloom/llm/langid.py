"""Language identification by rank-order n-gram profiles and their out-of-place distance."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.work import forget_others, map_batches, session_of, trim

#: Length of a profile, of a language and of a document.
PROFILE = 400
#: n-grams of 1 to ORDERS letters.
ORDERS = 3
#: Documents of each language that profiles are learned from, about; they are drawn by a hash over all of them.
TRAIN_ROWS = 4000
UNDETERMINED = "und"
#: Whether each code point is a letter; digits, fractions, superscripts and numerals of other kinds aren't.
_LETTER = np.fromiter((c.isalpha() for c in map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)
_U = np.uint64


def _codes(text: str) -> np.ndarray:
    """Codes of all n-grams within and at the edges of words; other characters than letters only part words."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[c]
    if not letter.any():
        return np.empty(0, _U)
    letter[0] = True  # the one space before the first word stays, and one after each
    c = np.where(_LETTER[c], c, 32)[letter | np.append(False, letter[:-1] & (c[:-1] != 32))].astype(_U)
    found, code = [c[c != 32]], c
    for n in range(1, ORDERS):
        code = (code[:-1] << _U(21)) | c[n:]
        found.append(code)
    return np.concatenate(found)


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The PROFILE most frequent codes, most frequent first, ties by code; and their counts."""
    code, n = np.unique(codes, return_counts=True)
    top = np.argsort(-n, kind="stable")[:PROFILE]
    return code[top], n[top]


def _count():
    def run(texts: list, langs: list) -> tuple:
        out: tuple[list, list, list] = ([], [], [])
        by: dict[str, list] = {}
        for text, lang in zip(texts, langs):
            by.setdefault(lang, []).append(_codes(text))
        for lang, codes in by.items():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            out[0].extend([lang] * len(code))
            out[1].extend(code.view(np.int64).tolist())
            out[2].extend(n.tolist())
        return out

    return run


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn_profiles(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, list[int]]:
    """{lang: codes, most frequent first} from labelled(text, lang, key), without rows of null text or lang.

    About train_rows documents of each language are read, those with the smallest hashes of key; PROFILE codes of each
    language come to the driver.
    """
    labelled = labelled.filter("text is not null and lang is not null").select("text", "lang", "key")
    many = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not many:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, min(1.0, train_rows / n))])
    drawn = labelled.filter(F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    counts = map_batches(drawn.select("text", "lang"), _count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.expr("row_number() over (partition by lang order by n desc, code)")).filter(F.col("place") <= PROFILE)
    found: dict[str, list[int]] = {lang: [] for lang in many}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.place)):
        found[r.lang].append(r.code)
    return found


def _predict(profiles: dict[str, list[int]]):
    def make():
        langs = sorted(profiles)
        known = np.unique(np.array([c for p in profiles.values() for c in p], np.int64).view(_U)) if langs else np.empty(0, _U)
        place = np.full((len(langs), len(known) + 1), -1, np.int64)
        for i, lang in enumerate(langs):
            place[i, np.searchsorted(known, np.array(profiles[lang], np.int64).view(_U))] = np.arange(len(profiles[lang]))

        def run(doc_ids: list, texts: list, out: list) -> tuple:
            pred, score = [], []
            for text in texts:
                codes = _codes(text) if text and langs else ()
                if not len(codes):
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                code, _ = _ranked(codes)
                at = np.searchsorted(known, code)
                at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] != code)] = len(known)
                ranks = place[:, at]
                far = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(code)))).sum(axis=1)
                best = int(far.argmin())
                pred.append(langs[best])
                score.append(float(1 - far[best] / (PROFILE * len(code))))
            return doc_ids, out, pred, score

        return run

    return make


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs(doc_id, text, held_out), predicted from the text alone.

    score is 1 less the out-of-place distance over its largest value. und with score 0 where the text is null or has no
    letter, or nothing has been learned; equal distances go to the first language by name.
    """
    return map_batches(docs.select("doc_id", "text", "held_out"), _predict(profiles), "doc_id long, held_out boolean, lang_pred string, score double")


def language_of(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): profiles learned from docs(doc_id, text, lang) whose crc32(doc_id) mod 4 is not 2
    (rows with null lang, text or doc_id teach nothing; rows that share a doc_id or a text each teach and each have a result),
    applied to every row's whole text. Characters that aren't letters only part words: a text without a letter is und. Other
    columns are ignored, whatever their names; no rows, no result."""
    session_of(docs)
    out = held_out(F.col("doc_id"), 4, 2)
    profiles = learn_profiles(docs.filter(~out & F.col("doc_id").isNotNull()).select("text", "lang", F.col("doc_id").alias("key")), train_rows)
    return identify(docs.select("doc_id", "text", out.alias("held_out")), profiles)


def _keep_determined(profiles: dict[str, list[int]], text_at: int):
    """Batches of whole rows without those that get no language from their own text."""

    def run(batches):
        import pyarrow as pa

        predict = _predict(profiles)()
        forget_others()
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            _, _, pred, _ = predict(texts, texts, texts)
            yield batch.filter(pa.array([p != UNDETERMINED for p in pred], pa.bool_()))
        trim()

    return run


def drop_undetermined(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows of docs whose text has a language; the others, null or without a letter, go, each by its own text.

    Profiles are learned as in language_of(); where nothing can be learned, rows with a letter stay.
    """
    session_of(docs)
    out = held_out(F.col("doc_id"), 4, 2)
    profiles = learn_profiles(docs.filter(~out & F.col("doc_id").isNotNull()).select("text", "lang", F.col("doc_id").alias("key")), train_rows)
    rows = docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if not profiles:
        return rows
    rows = rows.toDF(*[f"column_{i}" for i in range(len(docs.columns))])  # any names
    return rows.mapInArrow(_keep_determined(profiles, docs.columns.index("text")), rows.schema).toDF(*docs.columns)
