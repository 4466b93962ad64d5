"""Main text of web pages: a recurrent block labeller (operator 5).

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open
elements above it. A numpy bidirectional LSTM reads, for the sequence of all blocks of a page, a
vector of hashed path elements (tags, classes, ids), a vector of hashed words and a few
numbers (length, links, place), and labels every block as main text or not, with the whole page as context.

It is trained on at most ``SAMPLE`` pages of any length (by a hash of the html), with weak labels from
page conventions: navigation, headers, footers, asides, forms, adverts, notices and comments by element, class
or id aren't main text; what stands in an article, or outside all of these, is. A page is cut into windows of
``WINDOW`` blocks, and ``OF_PAGE`` of them, drawn by hash, are trained on, so page ends are as well as
beginnings. Labelling reads all blocks of a page as one sequence, in slices that carry the state. Pages of
similar length are labelled together as long as their padded blocks stay below ``CELLS``.

Defined results: null or empty html gives an empty text; markup that isn't closed ends with the
page, a comment or script that isn't closed swallows the rest; pages whose blocks are all rejected are
empty; null ids and urls and repeated rows are returned as they are; no rows give no rows; other
columns aren't read.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import exchange as X
from quarry.llm import kernel as K
from quarry.llm.recurrent import BiLSTM

SAMPLE, WINDOW, OF_PAGE = 256, 200, 2
PATH, WORDS = 48, 16       # hash slots of path elements and of words
NUMBERS = 6
MAIN = 0.5                 # least probability of main text
_SEQUENCES = 128           # labelled together, at most
CELLS = 1 << 14            # blocks labelled together with their padding, unless one page has more

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"                                        # comment
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|select)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*>(?:.*?</\1\s*>|.*)"   # raw text
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*)>"  # tag
    r"|<[!?/][^>]*>",                                           # declaration, stray end
    re.S | re.I)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Elements by how HTML lays them out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"])}
# Conventions of pages behind the weak labels.
ASIDE_TAGS = frozenset("nav footer aside form header menu button dialog".split())
ASIDE_MARK = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumb\w*|sidebar|footer|header|cookie\w*|consent|notice\w*|"
    r"alert|popup|modal|comment\w*|reply|replies|share|social|related|subscribe|newsletter|login|signup|copyright)(?:$|[\s_-])", re.I)


class Block:
    __slots__ = ("parts", "path", "linked")

    def __init__(self, path: tuple[str, ...]):
        self.parts: list[str] = []
        self.path, self.linked = path, 0


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path, characters inside links) of every block with text, in page order."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    open_: list[tuple[str, str]] = []            # (tag, tag with its marks)
    block = Block(())
    links = 0

    def text(raw: str) -> None:
        if raw:
            block.parts.append(raw)
            if links:
                block.linked += len(raw)

    def end() -> None:
        nonlocal block
        if block.parts:
            clean = " ".join(unescape("".join(block.parts)).split())
            if clean:
                out.append((clean, block.path, block.linked))
        block = Block(tuple(x for _, x in open_))

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                text(" ")
            continue
        name = name.lower()
        if m[2]:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if depth is not None:
                links -= sum(t == "a" for t, _ in open_[depth:])
                inline = all(t in INLINE for t, _ in open_[depth:])
                del open_[depth:]
                if not inline:
                    end()
            elif name not in INLINE:
                end()
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                text(" " if name != "wbr" else "")
            else:
                open_.append((name, name))
                links += name == "a"
            continue
        # a block-level start tag closes what it can't stand in, with the inline elements there
        for i in range(len(open_) - 1, -1, -1):
            tag = open_[i][0]
            if tag in CLOSED_BY and name in CLOSED_BY[tag]:
                links -= sum(t == "a" for t, _ in open_[i:])
                del open_[i:]
                break
            if tag not in INLINE and tag not in CLOSED_BY:
                break
        if name not in VOID:
            marks = " ".join(f"{a.lower()}={x or y or z}" for a, x, y, z in _MARKS.findall(m[4])) if m[4].strip() else ""
            open_.append((name, f"{name} {marks}".strip()))
        end()
    tail = page[at:]
    cut = re.search(r"<[a-zA-Z/!][^>]*$", tail)     # a tag that the page's end cuts off
    text(tail[:cut.start()] if cut else tail)
    end()
    return out


@lru_cache(1 << 16)
def _element(x: str) -> tuple[list[int], bool, bool]:
    """Slots of a path element, whether it marks an aside, whether an article."""
    tag, _, marks = x.partition(" ")
    names = re.split(r"[\s=]+", marks.lower()) if marks else []
    slots = [zlib.crc32(s.encode()) % PATH for s in (tag, *(f"{tag}.{n}" for n in names if n))]
    values = " ".join(re.findall(r"=([^=]*?)(?= \w+=|$)", marks)) if marks else ""
    return slots, tag in ASIDE_TAGS or bool(ASIDE_MARK.search(values)), tag in ("article", "main") and not ASIDE_MARK.search(values)


def weak_label(path: tuple[str, ...]) -> int:
    """1 for main text: the innermost element that says something decides, and none says so."""
    for x in reversed(path):
        _, aside, article = _element(x)
        if aside:
            return 0
        if article:
            return 1
    return 1


def vectors(blocks: list[tuple[str, tuple[str, ...], int]]) -> np.ndarray:
    """Inputs of the labeller for the blocks of one page or of several, one after another."""
    x = np.zeros((len(blocks), PATH + WORDS + NUMBERS))
    for i, (text, path, linked) in enumerate(blocks):
        for e in path:
            x[i, _element(e)[0]] = 1
        x[i, PATH + WORDS:PATH + WORDS + 4] = (np.log1p(len(text)) / 8, min(1.0, linked / len(text)),
                                               text[-1] in ".!?…", len(path) / 10)
    w = K.words(K.texts(pa.array([b[0] for b in blocks], pa.string())))
    n = np.maximum(1, w.count)
    slot = (w.h >> np.uint64(40)).astype(np.int64) % WORDS
    x[:, PATH:PATH + WORDS] = np.bincount(w.doc * WORDS + slot, minlength=len(blocks) * WORDS).reshape(-1, WORDS) / n[:, None]
    x[:, -2] = np.log1p(n) / 6
    return x


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of sampled pages (h, html) to train on: inputs and labels of their blocks."""
    for batch in batches:
        for h, page in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist()):
            blocks = leaf_blocks(page)
            starts = sorted(range(0, len(blocks), WINDOW), key=lambda lo: zlib.crc32(f"{h}:{lo}".encode()))[:OF_PAGE]
            rows = [blocks[lo:lo + WINDOW] for lo in starts]
            yield pa.record_batch({
                "h": pa.array([h] * len(rows), pa.int64()), "lo": pa.array(starts, pa.int64()),
                "inputs": pa.array([vectors(r).astype(np.float32).tobytes() for r in rows], pa.binary()),
                "labels": pa.array([bytes(weak_label(b[1]) for b in r) for r in rows], pa.binary())})


def train(pages: DataFrame, html_col: str = "html"):
    """A broadcast labeller from a bounded sample of the pages: SAMPLE * OF_PAGE windows reach the driver."""
    rows = pages.filter(F.length(html_col) > 0).select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    some = X.sample_hashes(rows, "h", SAMPLE)
    picked = rows.filter(F.col("h").isin(some)).groupBy("h").agg(F.min("html").alias("html"))
    windows = picked.mapInArrow(_drawn, "h long, lo long, inputs binary, labels binary").orderBy("h", "lo").toArrow()
    sequences = [(np.frombuffer(x, np.float32).reshape(len(y), -1).astype(float), np.frombuffer(y, np.uint8).astype(float))
                 for x, y in zip(windows.column("inputs").to_pylist(), windows.column("labels").to_pylist())]
    model = BiLSTM(PATH + WORDS + NUMBERS)
    if sequences:
        model.fit(sequences)
    return pages.sparkSession.sparkContext.broadcast(model)


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of pages with blocks, the shortest first, in groups whose padded size is bounded."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < min(len(order), lo + _SEQUENCES) and (hi + 1 - lo) * lengths[order[hi]] <= CELLS:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _labelled(sequences: list[list], model: BiLSTM) -> list[np.ndarray]:
    """Probabilities of the blocks of each page; pages of similar length go together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
    for mine in _groups(np.array([len(s) for s in sequences], int)):
        lengths = np.array([len(sequences[i]) for i in mine])

        def part(lo: int, hi: int):
            """Inputs of the steps lo to hi of the group's pages."""
            found = [sequences[i][lo:hi] for i in mine]
            inputs = vectors([b for f in found for b in f])
            live = np.arange(lo, hi)[:, None] < lengths
            x = np.zeros((hi - lo, len(mine), inputs.shape[1]))
            x.transpose(1, 0, 2)[live.T] = inputs
            return x, live
        p = model.label(part, int(lengths.max()), len(mine))
        for j, i in enumerate(mine):
            out[i] = p[:lengths[j], j]
    return out


def _extracted(html_col: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches, html_col, rows=1024, size=4 << 20):
            pages = [leaf_blocks(x) if x else [] for x in block.column(html_col).to_pylist()]
            main = ["\n".join(b[0] for b, q in zip(s, p) if q >= MAIN) for s, p in zip(pages, _labelled(pages, model.value))]
            yield from block.drop_columns([html_col]).append_column("text", pa.array(main, pa.string())) \
                .append_column("n_chars", pa.array([len(x) for x in main], pa.int64())).to_batches()
    return run


def extract(pages: DataFrame, model=None, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The `keep` columns of every page with text (main blocks in page order, joined by \\n) and
    n_chars."""
    model = model or train(pages, html_col)
    rows = pages.select(*keep, html_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != html_col]
    return rows.mapInArrow(_extracted(html_col, model), ", ".join([*fields, "text string", "n_chars long"]))
