"""Personal data and secrets: rules for plain forms, and boosted trees over candidate spans for all others.

Generators of high recall propose spans that may overlap; trees judge each by its format and its context; a span is redacted
where its calibrated probability reaches the threshold of its kind. Plain forms that pass their rule are always redacted.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.boosting import Boosted, calibrate, fit_boosted, threshold_for
from barloom.llm.work import map_batches, session_of

KINDS = ("email", "ip", "card", "phone", "secret")
#: Precision at which thresholds are set on held-out examples; number of examples of each kind and label; words of the corpus around them.
PRECISION, EXAMPLES, WORDS = 0.99, 400, 5000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits start a match only where they start: a match that fails there fails from inside the run too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Names whose values may be secret.
_SECRET_NAME = re.compile(r"(?i:key|token|secret|passw|pwd|auth|credential|bearer)")
#: What may be personal data in other forms than the plain ones: (kind, what a text needs for it, pattern, group of the span; 2: of
#: the value, if group 1 is a secret's name). Spans may overlap. A pattern reads no run of characters more than once.
GENERATORS = tuple(
    (kind, re.compile(need), re.compile(pattern), group)
    for kind, need, pattern, group in (
        ("email", r"(?i:[(\[{ ]at[)\]} ])", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[ ]?(?:\(at\)|\[at\]|\{at\}| at | AT )[ ]?[A-Za-z0-9-]+(?:(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?| dot | DOT |\.)[A-Za-z0-9-]{2,63})+", 0),
        ("email", r"[ ]@|@[ ]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[ ]?@[ ]?[A-Za-z0-9-]+(?:[ ]?\.[ ]?[A-Za-z0-9-]{2,63})+", 0),
        ("ip", r"[0-9]\[|[0-9]\(", r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])){3}[0-9]{1,3}(?![0-9A-Za-z])", 0),
        ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f:]", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])", 0),
        ("card", r"[0-9]{4}[ ./_-]", r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){3}(?![0-9A-Za-z])", 0),
        ("card", r"[0-9]{4}[ ./_-]", r"(?<![0-9A-Za-z])[0-9]{4}[ ./_-]{1,3}[0-9]{6}[ ./_-]{1,3}[0-9]{5}(?![0-9A-Za-z])", 0),
        ("phone", r"[0-9]{2,4}[) .-]", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[ ]?[0-9]{3}[ .-][0-9]{4}|00[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])", 0),
        ("phone", r"[0-9]{10}", r"(?<![0-9A-Za-z+.-])[0-9]{10,11}(?![0-9A-Za-z]|[.-][0-9])", 0),
        ("secret", r"[=:]", r"(?<![A-Za-z0-9_])([A-Za-z0-9_]++)[\"']?[ ]?(?::=|=>|[=:])[ ]?[\"']?(?=([^\s\"'<>,;=:]{8,}={0,2}))", 2),
        ("secret", r"[A-Za-z0-9+/_-]{20}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", 0),
    )
)
_CUES = {
    "email": ("mail", "contact", "write to", "reach", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "cell", "fax", "telefon"),
    "secret": ("key", "token", "secret", "passw", "pwd", "auth", "credential", "bearer"),
}
_AGAINST = ("order", "invoice", "isbn", "version", "serial", "id", "part", "ref", "sku", "article", "no.", "commit", "sha", "md5", "checksum", "digest", "http", "www")


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Plain forms that pass their rule, by kind and then by start; leftmost and not overlapping within a kind."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose, each span of a kind once; spans may overlap."""
    found = ((kind, m, group) for kind, need, pattern, group in GENERATORS if need.search(text) for m in pattern.finditer(text))
    return list(dict.fromkeys((kind, m.start(group), m.end(group)) for kind, m, group in found if group < 2 or _SECRET_NAME.search(m[1])))


def _entropy(s: str) -> float:
    n = np.array(list(Counter(s).values()), float)
    return float(-(n / len(s) * np.log2(n / len(s))).sum()) if s else 0.0


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span, and what stands around it."""
    s, before, after = text[start:end], text[max(0, start - 48) : start].lower(), text[end : end + 24].lower()
    d = _digits(s)
    parts = re.split(r"[^0-9A-Za-z]+", s)
    seps = [c for c in s if not c.isalnum()]
    letters = [c for c in s if c.isalpha()]
    return [
        *[float(kind == k) for k in KINDS],
        len(s), len(d), len(d) / len(s), len(letters) / len(s), len(seps), len(set(seps)), len(parts), max(map(len, parts)),
        float(luhn(d)) if d else 0.0, float(all(p.isdigit() and int(p) <= 255 for p in parts if p)), float("(" in s or "[" in s), float(s[:2] == "00"),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "=:\"'#/" and before != ""), float(bool(re.search(r"[=:>] ?[\"']?$", before))),
        *[float(any(c in before for c in _CUES[k])) for k in KINDS],
        float(any(re.search(rf"\b{re.escape(c)}", before) for c in _AGAINST)), float(s.islower()), float(d[:1] in ("3", "4", "5", "6") and d != ""),
        _entropy(s), float(all(c in "0123456789abcdefABCDEF" for c in s)), sum(c.isupper() for c in letters) / len(s), sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:])) / len(s), float("/" in s),
    ]


def _examples(words: list[str], n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): written-around personal data and secrets, and look-alikes, within words of the corpus."""
    r = np.random.default_rng(seed)
    words = words or ["the", "of", "and"]
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    some = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    lower, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    mixed = lower + lower.upper() + "0123456789"

    def name() -> str:
        part = lambda: some(lower, int(r.integers(3, 9)))
        return part() + pick(("", "", f".{part()}", f"_{part()}", num(2)))

    def card(ok: bool) -> str:
        d = pick(("4", "5", "37", "6011")) + num(15)
        d = d[:15]
        return next(d + str(c) for c in range(10) if luhn(d + str(c)) == ok)

    def secret(label: int) -> tuple[str, str, str]:
        """What stands before the span, the span, and what stands behind it."""
        if label:
            cue, link, quote = pick(("api_key", "token", "secret", "password", "auth_token", "access_key", "pwd", "API_KEY", "Bearer", "client_secret", "private_key")), pick((" = ", "=", ": ", ":", " => ", " := ")), pick(('"', "'", "", '"'))
            span = pick((some(hexa, int(r.integers(20, 65))), some(mixed, int(r.integers(16, 50))), some(mixed + "+/", int(r.integers(24, 64))) + pick(("", "=", "==")), f"{pick(('sk', 'ghp', 'pk', 'xoxb', 'AKIA'))}{pick(('_', '-', ''))}{some(mixed, int(r.integers(16, 40)))}"))
            return f"{cue}{link}{quote}", span, quote
        plain = pick(words) + pick((pick(words), pick(words).title()))
        long = "-".join(pick(words) for _ in range(int(r.integers(4, 8))))
        return pick((
            (f"{pick(('commit', 'sha256', 'md5', 'checksum', 'digest'))}{pick((' ', ': ', ' = '))}", some(hexa, pick((32, 40, 64))), ""),
            (f"{pick(('http://www.', 'https://'))}{pick(words)}.com/", pick((long, some(mixed, 22))), pick(("", "/"))),
            ("", long, ""), ("", "/".join(pick(words) for _ in range(6)), ""), ("", num(int(r.integers(20, 30))), ""), ("", pick(("-", "_", "=", "+")) * int(r.integers(20, 60)), ""),
            (f"{pick(('key', 'token', 'secret', 'password'))}{pick((': ', ' = '))}", plain + pick(("", "", "ing", "-" + plain)), ""), (f"{pick(('keyword', 'authors', 'keynote'))}: ", plain, ""),
        ))

    def one(kind: str, label: int) -> tuple[str, str, str]:
        cue = pick(_CUES[kind]) if r.random() < (0.5 if label else 0.1) else pick(words)
        if not label and r.random() < 0.6:
            cue = pick(_AGAINST)
        if kind == "secret":
            head, span, tail = secret(label)
            return f"{pick(words)} {pick(words)} {head}", span, f"{tail} {pick(words)}"
        if kind == "email":
            a, d = pick(("(at)", "[at]", " at ", " (at) ", " @ ", "@ ")), pick(("(dot)", "[dot]", " dot ", " (dot) "))
            d = pick((".", " . ")) if "@" in a else d
            span = f"{name()}{a}{name()}{d}{pick(('com', 'org', 'net', 'de'))}" if label else pick((f"{pick(words)} at {pick(words)}.{pick((pick(words), pick(words).title()))}", f"{num(2)} @ {num(1)}.{num(2)}"))
        elif kind == "ip":
            six = ":".join(some(hexa, int(r.integers(1, 5))) for _ in range(8))
            short = f"{some(hexa, 4)}:{some(hexa, 3)}::{some(hexa, int(r.integers(1, 5)))}"
            span = pick((pick(("[.]", "(.)", "[dot]")).join(str(r.integers(0, 256)) for _ in range(4)), six, short)) if label else pick((pick(("[.]", "(.)")).join(str(r.integers(300, 1000)) for _ in range(4)), f"{num(1)}::{num(1)}", f"{pick(('add', 'bad', 'face', 'dead'))}::{pick(('add', 'bee', 'fade'))}"))
        elif kind == "card":
            c = card(bool(label))
            span = pick(("/", ".", "_", "  ", " - ", "-", " ")).join(c[k : k + 4] for k in (0, 4, 8, 12))
        else:
            span = pick((f"({num(3)}) 555-{num(4)}", f"00{pick(('49', '33', '34', '1'))} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}")) if label else pick((f"{num(3)} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(2)} {num(2)}", num(10), num(11)))
            if label and r.random() < 0.3:
                cue, span = pick(_CUES["phone"]), pick((num(10), "1" + num(10)))
        return f"{pick(words)} {pick(words)} {cue}{pick((' ', ': '))}", span, f" {pick(words)} {pick(words)}"

    out = []
    for kind in KINDS:
        for label in (0, 1):
            for _ in range(n):
                head, span, tail = one(kind, label)
                text = head + span + tail
                for s, e in [(s, e) for k, s, e in candidates(text) if k == kind and s < len(head) + len(span) and e > len(head)]:
                    out.append((text, kind, s, e, label if (s, e) == (len(head), len(head) + len(span)) or not label else 0))
    return out


def train(words: list[str], precision: float = PRECISION) -> tuple[Boosted, dict[str, float]]:
    rows = _examples(words)
    x, y = np.array([features(*row[:4]) for row in rows]), np.array([row[4] for row in rows], float)
    fold = np.arange(len(rows)) % 4
    model = calibrate(fit_boosted(x[fold < 2], y[fold < 2]), x[fold == 2], y[fold == 2])
    held, p = fold == 3, model.probability(x)
    of = np.array([row[1] for row in rows])
    return model, {k: max(0.5, threshold_for(p[held & (of == k)], y[held & (of == k)], precision)) for k in KINDS}


def added_spans(text: str, base: list[tuple[str, int, int]], model: Boosted, least: dict[str, float]) -> list[tuple[str, int, int]]:
    """Candidates that reach their threshold, best first where they overlap; none that touches a plain span."""
    found = candidates(text)
    if not found:
        return []
    taken: list[list[int]] = []  # disjoint, by place
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])

    def place(s: int, e: int) -> int:
        """Where a span goes among those taken; -1 if it touches one."""
        k = bisect.bisect_left(taken, [s, e])
        return -1 if (k and taken[k - 1][1] > s) or (k < len(taken) and taken[k][0] < e) else k

    found = [c for c in found if place(c[1], c[2]) >= 0]
    if not found:
        return []
    p, out = model.probability(np.array([features(text, *c) for c in found])), []
    for i in np.lexsort(([c[1] - c[2] for c in found], -p)):
        kind, s, e = found[i]
        if p[i] >= least[kind] and (k := place(s, e)) >= 0:
            taken.insert(k, [s, e])
            out.append(found[i])
    return out


def _find(model: Boosted, least: dict[str, float]):
    def make():
        order = {k: i for i, k in enumerate(KINDS)}

        def run(doc_ids: list, texts: list) -> tuple:
            base_of, all_of = [], []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                spans = sorted([*base, *added_spans(text, base, model, least)], key=lambda s: (order[s[0]], s[1], s[2]))
                base_of.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                all_of.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            return doc_ids, base_of, all_of

        return run

    return make


SPANS = "array<struct<kind:string,start:long,end:long>>"


def corpus_words(docs: DataFrame, sample: int, most: int = WORDS) -> list[str]:
    """Up to `most` words of letters, by the smallest hashes, of whole texts of about `sample` documents that a hash of the text draws."""
    texts = docs.select("text").filter("text is not null")
    share = min(1.0, sample / max(1, texts.count()))
    drawn = texts.filter(F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(1 << 30)) < share * (1 << 30))
    words = drawn.select(F.explode(F.array_distinct(F.split("text", r"[\s]+"))).alias("w")).filter(F.col("w").rlike(r"^\p{L}+$")).distinct()
    placed = words.select(F.struct(F.xxhash64(F.lit(19), "w").alias("h"), "w").alias("x"))
    few = placed.filter(F.pmod("x.h", F.lit(1 << 30)) < min(1.0, 2 * most / max(1, words.count())) * (1 << 30))
    return [x.w for x in few.agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("all")).first()["all"]]


def find_pii(docs: DataFrame, sample: int = 200) -> DataFrame:
    """(doc_id, base, spans): the plain spans of each row of docs(doc_id, text), and all that are redacted.

    Spans are (kind, start, end) in code points, end exclusive, by kind in the order of KINDS and then by start; base spans are all
    in spans. The kinds of base spans are the first four; secrets (keys, tokens, passwords) are only found by the method. Null or
    empty texts have none; each row is judged by its own whole text, also where rows share a doc_id or a text; other columns are
    ignored, whatever their names; no rows, no result. Where candidates overlap, the likeliest stands, of equal ones the longer.
    The trees are trained at the start, on made-up examples set in words of about `sample` documents.
    """
    session_of(docs)
    return map_batches(docs.select("doc_id", "text"), _find(*train(corpus_words(docs, sample))), f"doc_id long, base {SPANS}, spans {SPANS}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first stands."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join([*out, text[at:]])
