"""Personal data: high-recall generators propose overlapping spans, boosted trees judge them by
format and context, calibrated thresholds select what is redacted (operator 9).

The four base kinds (email, ip, card, phone: fixed patterns and checks) always stay. Beside them
the generators propose looser spans: masked e-mail addresses, national phone numbers, dotted and
long digit groups, assigned or random-looking keys. Each candidate has numbers for its format
(length, digits, letters, entropy, separators, checksum) and its context (words before it, the
characters around it). The trees learn from weak labels: what a strict pattern of the kind
confirms, on half of a bounded sample of ``SAMPLE`` candidates: equally many hash classes (of the
text and place, over all texts) for each kind and weak label, so a rare kind is sampled however many
candidates the others have. All candidates are then scored, and counts by kind, score and label give
each kind the lowest threshold that reaches ``PRECISION``; a kind without one adds nothing.

Texts are searched in full; those without a digit or @ or assignment skip the patterns for these.
Patterns take linear time on runs of any length.

Defined results: a null text is empty; null ids and repeated rows are returned each; candidates of
equal place are ordered by kind; with no candidates nothing is added; no rows give no rows; other
columns aren't read by ``find`` and pass through ``redact``.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import exchange as X
from quarry.llm import kernel as K
from quarry.llm.boosting import Trees

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account")     # in the order of equal starts
SAMPLE = 20_000           # candidates that are gathered for the trees, at most
PRECISION = 0.98
STEP = 0.01               # width of the thresholds' score bins, in log-odds
CONTEXT = 24              # characters before a candidate that its features read

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MASKED = re.compile(r"(?<![\w.-])[\w.-]{1,64}[ ]?[(\[](?:at|AT)[)\]][ ]?[\w-]{1,64}(?:[ ]?(?:[(\[](?:dot|DOT)[)\]]|\.)[ ]?[\w-]{2,24})+")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![0-9])")
_DIGITS = re.compile(r"(?<![0-9A-Za-z])[0-9]{7,34}(?![0-9A-Za-z])")
_KEY = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9_+/=-])")     # and a digit
_DIGIT = re.compile(r"[0-9]")
_ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\s{0,2}[:=]\s{0,2}[\"']?$")
_CUES = {name: re.compile(rf"(?i)\b(?:{words})\b") for name, words in {
    "email": "mail|email|e-mail|contact", "phone": "phone|tel|call|mobile|fax", "card": "card|visa|credit|payment",
    "account": "iban|account|ssn|passport|number", "secret": "token|key|secret|password|passwd|pwd"}.items()}


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """The checksum of card numbers: every second digit from the right counts double."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str, digits: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds, by start and kind."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if digits:
        for m in _IP.finditer(text):
            # a number of more than three digits without leading zeros is over 255
            if all(len(p) < 4 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]], digits: bool) -> list[tuple[int, int, str]]:
    """Spans of all generators beside the base's, overlapping ones included."""
    out = set(base)
    if "[" in text or "(" in text:
        out |= {(*m.span(), "email") for m in _MASKED.finditer(text)}
    if digits:
        out |= {(*m.span(), "phone") for m in _NATIONAL.finditer(text) if 7 <= len(_digits(m[0])) <= 15}
        out |= {(*m.span(), "account") for m in _DIGITS.finditer(text)}
        out |= {(*m.span(), "secret") for m in _KEY.finditer(text) if _DIGIT.search(m[0])}
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    """Format and context of a candidate as numbers."""
    a, b, kind = span
    s, before = text[a:b], text[max(0, a - CONTEXT):a]
    after = text[b:b + 1]
    d = _digits(s)
    letters = sum(c.isalpha() for c in s)
    counts = np.unique(np.frombuffer(s.encode("utf-32-le"), np.uint32), return_counts=True)[1] / len(s)
    parts = [p for p in re.split(r"[^0-9]+", s) if p]
    return [*(float(kind == k) for k in KINDS), min(len(s), 200), len(d), letters / len(s), len(d) / len(s),
            float(-(counts * np.log2(counts)).sum()), float(len(d) >= 12 and luhn(d)), len(parts),
            max((len(p) for p in parts), default=0), min((len(p) for p in parts), default=0),
            float(s[0] in "+("), s.count("."), s.count("-") + s.count(" "), float("@" in s),
            float(s == s.lower()), float(bool(_ASSIGNED.search(before))),
            *(float(bool(c.search(before))) for c in _CUES.values()),
            float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in ("\"", "'", "=", ":"))]


def weak_label(text: str, span: tuple[int, int, str], base: set[tuple[int, int, str]]) -> bool:
    """What a strict pattern of the kind says."""
    a, b, kind = span
    if span in base:
        return True
    s, before = text[a:b], text[max(0, a - CONTEXT):a]
    if kind == "email":
        return True                          # an address masked on purpose
    if kind == "phone":
        return bool(re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s) or _CUES["phone"].search(before))
    if kind == "secret":
        return bool(_ASSIGNED.search(before)) and any(c.isdigit() for c in s)
    if kind == "account":
        return bool(_CUES["account"].search(before))
    return False


def _marked(text_col: str, batches: Iterator[pa.RecordBatch]):
    """(block, texts, which have a digit or a bracket) of a task."""
    mark = np.zeros(256, bool)
    mark[0x30:0x3A] = True
    for block in K.blocks(batches, text_col):
        t = K.texts(block.column(text_col))
        yield block, ["" if x is None else x for x in block.column(text_col).to_pylist()], K.per_text(mark[t.buf], t.off) > 0


def _sampled(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, digits in _marked(text_col, batches):
            rows = []
            for text, d in zip(texts, digits):
                base = base_spans(text, d)
                found = candidates(text, base, d)
                if found:
                    own, known = xxhash.xxh64_intdigest(text), set(base)
                    for s in found:
                        rows.append({"h": xxhash.xxh64_intdigest(f"{own}:{s}") >> 1, "kind": s[2],
                                     "y": int(weak_label(text, s, known)), "x": features(text, s)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("h", pa.int64()), ("kind", pa.string()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))]))
    return run


class Judge:
    """Trees with a threshold for each kind, as a score bin."""

    def __init__(self, trees: Trees, least: dict[str, int]):
        self.trees, self.least = trees, least

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.floor(self.trees.score(x) / STEP).astype(np.int64)

    def added(self, text: str, digits: bool) -> tuple[list, list]:
        """(base spans, all spans that are selected)."""
        base = base_spans(text, digits)
        more = [s for s in candidates(text, base, digits) if s not in base]
        if more:
            at = self.bins(np.array([features(text, s) for s in more]))
            more = [s for s, k in zip(more, at) if k >= self.least.get(s[2], np.inf)]
        return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _scored(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
                kind = np.array([KINDS.index(k) for k in batch.column("kind").to_pylist()])
                found, n = np.unique(np.stack([kind, judge.bins(x), batch.column("y").to_numpy()], 1), axis=0, return_counts=True)
                yield pa.record_batch({"kind": pa.array([KINDS[k] for k in found[:, 0]], pa.string()), "bin": pa.array(found[:, 1].copy()),
                                       "y": pa.array(found[:, 2].astype(np.int32)), "n": pa.array(n.astype(np.int64))})
    return run


def thresholds(found: DataFrame, trees: Trees) -> dict[str, int]:
    """Each kind's lowest score bin that reaches PRECISION over all candidates (kind, y, x)."""
    scored = found.select("kind", "y", "x").mapInArrow(_scored(Judge(trees, {})), "kind string, bin long, y int, n long")
    rows = scored.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("right")).collect()
    least = {}
    for k in KINDS:
        mine = np.array(sorted((r["bin"], r["n"], r["right"]) for r in rows if r["kind"] == k)[::-1]).reshape(-1, 3)
        good = np.flatnonzero(np.cumsum(mine[:, 2]) >= PRECISION * np.cumsum(mine[:, 1]))
        if len(good) and mine[:, 2].any():
            least[k] = int(mine[good[-1], 0])
    return least


def train(docs: DataFrame, text_col: str = "text"):
    """A broadcast Judge: trees from a bounded sample of the candidates of `docs`, thresholds from all."""
    found = X.table(docs.select(text_col).mapInArrow(_sampled(text_col), "h long, kind string, y int, x array<double>"), "candidates")
    classes = SAMPLE // (2 * len(KINDS))
    picked = found.groupBy("kind", "y", F.pmod("h", F.lit(classes))).agg(F.min("h").alias("h")).select("h").collect()
    some = found.sparkSession.createDataFrame([(r["h"],) for r in picked], "h long")
    rows = found.join(F.broadcast(some), "h").dropDuplicates(["h"]).orderBy("h").toArrow()     # SAMPLE rows at most
    y = rows.column("y").to_numpy()
    x = np.array(rows.column("x").to_pylist(), float) if len(y) else np.zeros((0, 1))
    part = rows.column("h").to_numpy() // classes % 2 == 0
    trees = Trees().fit(x[part], y[part])
    return docs.sparkSession.sparkContext.broadcast(Judge(trees, thresholds(found, trees)))


_SPAN = "struct<start:long,end:long,kind:string>"


def _found(id_col: str, text_col: str, judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        named = lambda spans: [dict(zip(("start", "end", "kind"), s)) for s in spans]
        for block, texts, digits in _marked(text_col, batches):
            both = [judge.value.added(t, d) for t, d in zip(texts, digits)]
            yield from pa.table({id_col: block.column(id_col).cast(pa.int64()),
                                 "base": pa.array([named(b) for b, _ in both], span),
                                 "every": pa.array([named(e) for _, e in both], span)}).to_batches()
    return run


def find(docs: DataFrame, judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, `base` and `every`: arrays of (start, end, kind), in code points."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return rows.mapInArrow(_found(id_col, text_col, judge), f"{id_col} long, base array<{_SPAN}>, every array<{_SPAN}>")


def _redacted(text_col: str, judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts, digits in _marked(text_col, batches):
            out = []
            null = block.column(text_col).is_null().to_pylist()
            for text, d, none in zip(texts, digits, null):
                done, parts = 0, []
                for a, b, kind in judge.value.added(text, d)[1]:
                    if a >= done:
                        parts += [text[done:a], f"<{kind.upper()}>"]
                    done = max(done, b)
                out.append(None if none else "".join([*parts, text[done:]]))
            at = block.schema.get_field_index(text_col)
            yield from block.set_column(at, block.schema.field(at), pa.array(out, block.schema.field(at).type)).to_batches()
    return run


def redact(docs: DataFrame, judge, text_col: str = "text") -> DataFrame:
    """`docs` with every selected span of the text replaced by <KIND>; overlapping spans become
    one, named after the first."""
    return docs.mapInArrow(_redacted(text_col, judge), docs.schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns."""
    found = find(docs, train(docs, text_col), id_col, text_col)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(id_col, *map(count, BASE),
                        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("every").alias("spans"))
