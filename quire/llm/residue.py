"""Template residue, filler and error notices where content should stand.

Character n-gram models are fitted for filler, for notices (errors, missing scripts) and for
template prompts, from the phrase grammars of ``phrases``, and for natural prose from the whole
corpus, where each distinct clause counts once, however many copies of it there are. Every
unit of a text (a sentence of a line) is read in windows; a window whose likelihood under a
residue model exceeds that under prose marks its characters, and a unit that is mostly
marked is residue. What a reading finds is taken out of the prose counts, and filler is added
to its model, so that fillers of words the examples lack are found by the later readings.

Placeholders are found the same way, by models of character shapes in the windows that start
at their opening marks, and then checked against their grammar. What keeps to the grammar is
taken out before windows are counted as prose: the text around a placeholder varies without end,
so in a large corpus these windows would outnumber the others and pass for prose.

Quotations, code and formulas are no content of the text itself and are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import phrases
from quire.session import cut, spread

ORDER = 5
TABLE_BITS = 19
BLOCK = 1 << 15
WINDOW = 24
#: Texts that are read at once.
PART = 1000
#: Share of a model in its mixture with prose, and the least mean log-likelihood ratio of a marked window.
SHARE, LEAST_RATIO = 0.9, 0.6
#: Coverage that makes a unit residue: in the readings from which models learn, and in the last.
LEARN_COVERAGE, LEARN_OTHERS, COVERAGE = (0.6, 0.6), 0.9, 0.7
LEAST_CHARS = 8
#: The least coverage that is asked for, and the least mean ratio that a text of it can have.
LEAST_COVERED = 0.6
LEAST_MEAN = LEAST_COVERED * 0.5 * LEAST_RATIO + (1 - LEAST_COVERED * 0.5) * float(np.log(1 - SHARE))
CLASSES = ("filler", "notice", "prompt")
#: Classes whose models learn from what is found. Notices and prompts are phrases that
#: running sentences about them share; their models stay as the examples make them.
LEARNT = ("filler",)
COUNTER_SHARE = 0.3
#: Characters of a window of shapes, and buckets of their trigrams.
SITE, SITE_BUCKETS = 24, 1 << 14
#: Between the parts of a shape.
GLUE = "\x1f"

#: Marks of what a text only speaks of: fenced blocks, code spans, formulas, quotations.
_FENCE = regex.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*\r?$|\Z)", regex.M | regex.S)
_SPOKEN = regex.compile(
    r"``[^`]+``|`[^`\n]*`"
    r"|\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\$(?![A-Z][A-Z_0-9]+\$)[^$\n]++\$"
    r"|\"(?:[^\"\n]|\n(?![ \t\r]*\n))++\"|[“„«‹「]",
    regex.S,
)
#: The end of what each opening mark quotes: its closing mark, if no paragraph ends before.
_QUOTED_TO = {c: regex.compile(rf"[{closing}]|\n[ \t\r]*\n") for c, closing in {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」"}.items()}
_CAPITALS = regex.compile(r"[A-ZÄÖÜ_]{2,}")
#: The grammar of placeholders, by their delimiters.
_PLACEHOLDER = regex.compile(
    r"\{\{\s*[\w.\-]+(?:\s*\|\s*[\w.\-]+)?\s*\}\}|\{%-?\s*\w++[^%\n]*+%\}|<%=?\s*[\w.\-]+\s*%>|[#$]\{\s*[\w.\-]+\s*\}"
    r"|%%[A-Z][A-Z0-9_]*%%|@@[A-Z][A-Z0-9_]*@@|\$[A-Z][A-Z0-9_]+\$|(?<![\w_])__[A-Z][A-Z0-9_]*?__(?![\w_])|«[A-ZÄÖÜ][A-ZÄÖÜ_]+»"
    r"|<(?:[A-Z][A-Z_]*(?: [A-Z][A-Z_]*)* HERE|(?:your|YOUR|insert|INSERT)[ _-][\w -]++|[A-Z]{2,}_[A-Z_]+)>"
    r"|\[(?i:insert|your|add|enter|tbd|todo|tba|fill in|placeholder|insérer|votre|einfügen|hier|insertar|su|your)\b[^\]\n\[]*+\]|\[object Object\]|\[\[[A-Z][A-Z0-9_ ]*\]\]"
    r"|(?<![\w%])%[sd](?!\w)|(?<![\w\\{}$_^])\{\d?\}(?![\w{}])"
)
#: Marks that may open one, in that place: a number in braces or a letter after % stands alone.
_OPENER = re.compile(r"\{(?!\d?\})|(?<![\w\\{}$_^])\{(?=\d?\}(?![\w{}]))|[\[«]|<(?=[%\w])|\$(?=[A-Z{])|%(?=%)|(?<![\w%])%(?=[sd](?!\w))|@(?=@)|#(?=\{)|(?<![\w_])_(?=_)")
_END = re.compile(r"[.!?][\"”»')]*\s+")
_CLAUSE = re.compile(r"[,;:] ")
_TAG = regex.compile(r"</?[a-zA-Z][^<>\n]*+>")
_DIGIT = re.compile(r"\d")


def spoken_out(text: str) -> str:
    """The text with what it only speaks of blanked by U+FFFC."""
    text = _FENCE.sub("\n", text)
    out, at, done = [], 0, 0
    ends: dict[str, int] = {}  # where the next end for each opening mark is, so that the text is searched once
    while m := _SPOKEN.search(text, at):
        start, end = m.span()
        mark = text[start]
        if mark in _QUOTED_TO:
            if ends.get(mark, -1) < end:
                close = _QUOTED_TO[mark].search(text, end)
                ends[mark] = close.start() if close else len(text)
            to = ends[mark]
            if to in (end, len(text)) or text[to] == "\n" or mark == "«" and _CAPITALS.fullmatch(text, end, to):
                at = end
                continue
            end = to + 1
        out += [text[done:start], "￼"]
        at = done = end
    return "".join(out) + text[done:]


def units(text: str) -> list[str]:
    """Sentences of lines without tags and list marks; digits are 9, white space is one blank."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    out = []
    for line in _DIGIT.sub("9", text).splitlines():
        begin = 0
        for m in _END.finditer(line):
            then = line[m.end() : m.end() + 1]
            if then and (then.isupper() or then.isnumeric() or then in "<[¿¡"):
                out.append(line[begin : m.end()])
                begin = m.end()
        out.append(line[begin:])
    return [u for u in (" ".join(part.lstrip("-*#>|• \t\xa0").split()) for part in out) if u]


def pieces(unit: str) -> list[str]:
    """The clauses of a unit, each with the characters of the next one that its last n-grams reach into."""
    ends = [m.end() for m in _CLAUSE.finditer(unit)]
    return [unit[a : b + ORDER - 1] for a, b in zip([0, *ends], [*ends, len(unit)], strict=True)]


# -- models ------------------------------------------------------------------------------


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with one blank around each, and the number of the text of each."""
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    joined = "".join(f" {t} " for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), np.repeat(np.arange(len(texts)), sizes)


def _hashed(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each place, and whether it lies in one text."""
    size = len(points) - ORDER + 1
    if size <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    h = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            h = (h ^ points[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), owner[:size] == owner[ORDER - 1 :]


def gram_counts(texts: list[str]) -> np.ndarray:
    points, owner = _points(texts)
    bucket, whole = _hashed(points, owner)
    return np.bincount(bucket[whole], minlength=1 << TABLE_BITS)


def _example_share(patterns: list[str]) -> np.ndarray:
    """Shares of n-grams in the texts of the patterns, each pattern weighing the same."""
    total = np.zeros(1 << TABLE_BITS)
    for pattern in patterns:
        counts = gram_counts([normal(t) for t in phrases.expand(pattern)])
        total += counts / max(counts.sum(), 1)
    return total / total.sum()


def normal(unit: str) -> str:
    return _DIGIT.sub("9", unit.lower())


@dataclass
class Models:
    """Log-likelihood ratios to prose, by class and bucket."""

    ratios: np.ndarray

    @staticmethod
    def fit(prose: np.ndarray, found: dict[str, np.ndarray] | None = None) -> Models:
        """``prose``: counts of the distinct clauses of the corpus; ``found``: counts of the residue of each class among them."""
        found = found or {}
        rest = np.maximum(prose - sum(found.values()), 0) if found else prose
        spoken = _example_share(phrases.SPOKEN)
        natural = (1 - COUNTER_SHARE) * (rest + 0.5) / (rest.sum() + 0.5 * len(rest)) + COUNTER_SHARE * spoken
        ratios = []
        for name in CLASSES:
            share = _example_share(phrases.PATTERNS[name])
            seen = found.get(name) if name in LEARNT else None
            if seen is not None and seen.sum():
                share = 0.5 * share + 0.5 * seen / seen.sum()
            ratios.append(np.log(SHARE * share / natural + 1 - SHARE))
        return Models(np.array(ratios, dtype=np.float32))

    def coverage(self, texts: list[str]) -> np.ndarray:
        """Texts x classes: the share of each normalised text that marked windows cover, 0 where it is under ``LEAST_COVERED``.

        Half of what windows cover lies in windows that do not overlap; so a text that is covered so
        far has a mean ratio of at least ``LEAST_MEAN`` under its best class at each place, and the
        others are not looked at window by window.
        """
        out = np.zeros((len(texts), len(CLASSES)))
        if not texts:
            return out
        points, owner = _points(texts)
        bucket, whole = _hashed(points, owner)
        mean = np.bincount(owner[: len(bucket)][whole], weights=self.ratios.max(0)[bucket[whole]], minlength=len(texts)) / np.maximum(np.bincount(owner) - ORDER + 1, 1)
        near = np.flatnonzero(mean >= LEAST_MEAN)
        if len(near):
            out[near] = self._covered([texts[k] for k in near])
        return out

    def _covered(self, texts: list[str]) -> np.ndarray:
        points, owner = _points(texts)
        bucket, whole = _hashed(points, owner)
        sizes = np.bincount(owner)
        grams = np.maximum(sizes - ORDER + 1, 1)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out = np.zeros((len(texts), len(CLASSES)))
        start = np.arange(len(bucket))
        # a window of a short text is the whole text
        last = np.minimum(start + WINDOW, (first + grams)[owner[: len(bucket)]])
        full = whole & ((last - start == WINDOW) | (start == first[owner[: len(bucket)]]))
        for c in range(len(CLASSES)):
            ratio = np.where(whole, np.clip(self.ratios[c][bucket], -3, 6), 0.0)
            sums = np.concatenate(([0.0], np.cumsum(ratio)))
            mean = (sums[np.minimum(last, len(bucket))] - sums[start]) / np.maximum(last - start, 1)
            marked = np.flatnonzero(full & (mean > LEAST_RATIO))
            edges = np.zeros(len(bucket) + 1)
            np.add.at(edges, marked, 1)
            np.add.at(edges, np.minimum(last[marked], len(bucket)), -1)
            covered = (np.cumsum(edges[:-1]) > 0) & whole
            out[:, c] = np.bincount(owner[: len(bucket)][covered], minlength=len(texts)) / grams
        return out


# -- placeholders ------------------------------------------------------------------------


#: Letters and digits to their classes.
_CLASS = {k: ("9" if chr(k).isdigit() else "A" if chr(k).isupper() else "a") for k in range(0x250) if chr(k).isalnum()}
_RUN = re.compile(r"([aA9 ])\1\1+")
_WORD = re.compile(r"[<\[]\s*([^\W\d_]+)")


def shape(window: str) -> str:
    """Marks of a window as they are, letters, digits and blanks by class, two for a longer run; before them the first word after < or [."""
    word = _WORD.match(window)
    return (word.group(1).lower() if word else "") + GLUE + _RUN.sub(r"\1\1", window.translate(_CLASS))


def sites(text: str) -> list[tuple[int, str]]:
    """Place and window of every mark that may open a placeholder; a window ends with its line."""
    return [(m.start(), text[m.start() : m.start() + SITE].split("\n", 1)[0]) for m in _OPENER.finditer(text)]


def _shape_buckets(shaped: str) -> list[int]:
    """Buckets of the first word and of the trigrams of a shape, in order."""
    word, marks = shaped.split(GLUE, 1)
    grams = [marks[k : k + 3] for k in range(max(len(marks) - 2, 1))]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % SITE_BUCKETS for g in ([marks[0] + GLUE + word] if word else []) + grams]


def shape_counts(shapes: list[str]) -> np.ndarray:
    return np.bincount(np.array([b for s in shapes for b in _shape_buckets(s)], dtype=np.int64), minlength=SITE_BUCKETS)


class Shapes:
    """Whether a window has the shape of a placeholder rather than one of prose."""

    def __init__(self, prose: np.ndarray):
        examples = [f"{p}{after}" for p in phrases.placeholder_examples() for after in ("", ".", "}", " and the", ", which")]
        counts = shape_counts([shape(e[:SITE]) for e in examples])
        share, natural = counts / counts.sum(), (prose + 0.5) / (prose.sum() + 0.5 * len(prose))
        self.ratios = np.log(SHARE * share / natural + 1 - SHARE)
        self.known: dict[str, bool] = {}

    def __call__(self, window: str) -> bool:
        shaped = shape(window)
        if shaped not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[shaped] = bool(np.cumsum(self.ratios[_shape_buckets(shaped)]).max() > 0)
        return self.known[shaped]


def placeholders(text: str, likely) -> int:
    """Unfilled placeholders of a text without what it speaks of: windows of their shape that keep to the grammar."""
    n = done = 0
    for at, window in sites(text):
        if at >= done and likely(window):
            m = _PLACEHOLDER.match(text, at)
            if m:
                n, done = n + 1, m.end()
    return n


def filled(text: str) -> str:
    """The text with U+FFFC for what keeps to the grammar of placeholders."""
    out, done = [], 0
    for at, _ in sites(text):
        if at >= done and (m := _PLACEHOLDER.match(text, at)):
            out += [text[done:at], "\ufffc"]
            done = m.end()
    return "".join(out) + text[done:]


# -- reading -----------------------------------------------------------------------------


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, some at a time: many arrays as long as their texts are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def _distinct(docs: DataFrame) -> DataFrame:
    """Each distinct normalised clause (``kind`` u) and shape of a window (s) of all texts, placeholders left out, once, in column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found: dict[str, dict[str, None]] = {"u": {}, "s": {}}
            for text in batch.column(0).to_pylist():
                if text:
                    plain = spoken_out(text)
                    found["u"].update((p, None) for u in units(plain) for p in pieces(u.lower()))
                    found["s"].update((shape(w), None) for _, w in sites(filled(plain)))
            rows = [(k, t) for k, texts in found.items() for t in texts]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "text"])

    return cut(docs.select("text").mapInArrow(run, "kind string, text string").distinct())


def _blocks(name: str, counts: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    for at in range(0, len(counts), BLOCK):
        block = counts[at : at + BLOCK]
        if block.any():
            yield name, at // BLOCK, block.astype(np.int64).tobytes()


def _sum(df: DataFrame, count) -> dict[str, np.ndarray]:
    """Sum of the count tables that ``count(texts)`` gives for each batch; their size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, counts in count(batch.column(0).to_pylist()).items():
                sums[name] = sums[name] + counts if name in sums else counts
        rows = [row for name, counts in sums.items() for row in _blocks(name, counts)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["name", "block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, block, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = np.frombuffer(counts, dtype=np.int64)
                sums[name, block] = sums[name, block] + part if (name, block) in sums else part
        yield pa.record_batch([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["name", "block", "counts"])

    schema = "name string, block int, counts binary"
    out: dict[str, np.ndarray] = {}
    for r in df.select("text").mapInArrow(run, schema).repartition(16, "name", "block").mapInArrow(add, schema).collect():
        table = out.setdefault(r.name, np.zeros(1 << TABLE_BITS, dtype=np.int64))
        part = np.frombuffer(bytes(r.counts), dtype=np.int64)
        table[r.block * BLOCK : r.block * BLOCK + len(part)] += part
    return out


RESULT = "doc_id bigint, n_placeholders int, filler_chars bigint, notice_chars bigint, prompt_chars bigint, n_chars bigint"


def score(documents: DataFrame) -> DataFrame:
    """Residue of every document: placeholders, and characters of units of each class.

    Columns ``RESULT``; ``n_chars`` counts the normalised characters that were read. Null and
    empty texts have no residue. Repeated documents keep a row each. An empty table gives an
    empty result. Counts cover every text in whole. Copies of a clause weigh nothing in the
    models, so that a large group of them does not pass for prose.
    """
    docs = spread(documents.select("doc_id", "text"), "doc_id")
    distinct = _distinct(docs)
    read = distinct.filter("kind = 'u'")
    none = np.zeros(1 << TABLE_BITS, dtype=np.int64)
    prose = _sum(read, lambda texts: {"prose": gram_counts(texts)}).get("prose", none)
    shapes = _sum(distinct.filter("kind = 's'"), lambda texts: {"shape": shape_counts(texts)}).get("shape", none)
    context = documents.sparkSession.sparkContext
    models = context.broadcast(Models.fit(prose))  # 6 MB at any scale
    likely = context.broadcast(Shapes(shapes[:SITE_BUCKETS]))

    for least in LEARN_COVERAGE:

        def learn(texts: list[str], models=models, least=least) -> dict[str, np.ndarray]:
            out = {}
            cover = models.value.coverage(texts)
            for c, name in enumerate(CLASSES):
                mine = [u for u, k in zip(texts, cover, strict=True) if len(u) >= LEAST_CHARS and k[c] >= (least if name in LEARNT else LEARN_OTHERS) and k.argmax() == c]
                if mine:
                    out[name] = gram_counts(mine)
            return out

        models = context.broadcast(Models.fit(prose, _sum(read, learn)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            n = batch.num_rows
            place: dict[str, int] = {}
            unit, owner, held = [], [], np.zeros(n, dtype=np.int32)
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    plain = spoken_out(text)
                    held[k] = placeholders(plain, likely.value)
                    mine = [place.setdefault(u.lower(), len(place)) for u in units(plain)]
                    unit += mine
                    owner += [k] * len(mine)
            cover = models.value.coverage(list(place))
            sizes, unit, owner = np.array([len(u) for u in place], dtype=np.int64), np.array(unit, dtype=np.int64), np.array(owner, dtype=np.int64)
            total = lambda weights: pa.array(np.bincount(owner, weights=weights[unit], minlength=n).astype(np.int64))
            good = [np.where((cover[:, c] >= COVERAGE) & (sizes >= LEAST_CHARS), sizes, 0) for c in range(len(CLASSES))]
            yield pa.record_batch([batch.column(0), pa.array(held), *map(total, good), total(sizes)], names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.mapInArrow(run, RESULT)


def residual(scored: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that hold residue in place of content."""
    return scored.filter((F.col("n_placeholders") > 0) | (F.col("filler_chars") + F.col("notice_chars") + F.col("prompt_chars") > 0)).select("doc_id")
