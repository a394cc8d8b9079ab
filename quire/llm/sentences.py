"""Sentence boundaries in many languages and scripts.

Whether a full stop ends a sentence is decided from how the words around it occur where
they are unambiguous: elsewhere in the same document (``source``), and in the whole corpus
where the document says nothing. A word whose stop is followed by a small letter or a comma
is an abbreviation; one that closes paragraphs can end sentences; a capitalised word that
is also written small, or that opens paragraphs, starts sentences; one that is capitalised
within sentences is a name. No list of abbreviations or names is used.

Terminators belong to scripts: ideographic and Devanagari marks always end a sentence,
Thai ends one at a blank, a full stop ends one in scripts that use it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, spread

#: Marks that always end a sentence, marks that may, closing and opening marks.
SURE = "。！？｡।॥؟۔!?‼⁇⁈⁉։።"
STOPS = ".…"
CLOSERS = "\"”»“’'）)]」』】》〉›"
PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "‹": "›"}
MARK = regex.compile("[" + regex.escape("`$\"" + "".join(PAIRS) + "".join(PAIRS.values())) + "]")
OPENED_BY = {")": "(", "]": "[", "）": "（"}
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
DANDA_SCRIPT = regex.compile(r"[\p{Devanagari}\p{Bengali}]")
THAI_GAP = regex.compile(r"(?<=\p{Thai})\s+(?=\p{Thai})")
CODE = regex.compile(r"`(?:[^`\n]|\n(?![ \t\r]*\n))*+`|\$(?:[^$\n]|\n(?![ \t\r]*\n))++\$")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}'’_\-]|\.(?=[\p{L}\p{N}]))*")
ENDING = regex.compile(rf"(?:[{SURE}]|\.|…)(?:\s?(?:[{SURE}]|\.|…))*")
#: What is counted of a word: small or comma after its stop, a number after it, its stop at a block's
#: end, before anything else, blocks with its stop not at the end, without a stop, small first letter, opening a block or following a certain
#: end, capitalised inside.
FEATURES = ("stop_inside", "stop_digit", "stop_last", "stop_other", "stop_blocks", "bare", "small", "opens", "inside")
#: Blocks in which a word that is never without its stop closes nothing, from which it is an abbreviation.
ENOUGH = 10
#: Blocks that ask for a word of a source, or sources that have a word, above which the row of that
#: word is broadcast; there are at most as many such rows as this number goes into all rows.
HOT_LEAST, HOT_PARTS = 2_000, 100_000


def spans(text: str) -> list[tuple[int, int, bool]]:
    """Quotations, brackets, code and formulas: start, end, and whether it is quoted or bracketed.

    A mark without its partner encloses nothing.
    """
    found: list[tuple[int, int, bool]] = []
    at = 0
    code = {m.start(): m.end() for m in CODE.finditer(text)}
    closing: dict[str, list[int]] = defaultdict(list)
    marks = [(m.start(), m.group()) for m in MARK.finditer(text)]
    for k, c in marks:
        closing[c].append(k)
    used = {c: 0 for c in closing}
    # partners of nested brackets of one kind, all in one scan
    nested: dict[str, dict[int, int]] = {c: {} for c in "([（"}
    open_at: dict[str, list[int]] = {c: [] for c in nested}
    for k, c in marks:
        if c in open_at:
            open_at[c].append(k)
        elif c in OPENED_BY and open_at[OPENED_BY[c]]:
            nested[OPENED_BY[c]][open_at[OPENED_BY[c]].pop()] = k

    def partner(marks: str, start: int) -> int:
        best = -1
        for c in marks:
            places = closing.get(c, [])
            k = used.get(c, 0)
            while k < len(places) and places[k] <= start:
                k += 1
            used[c] = k
            if k < len(places) and (best < 0 or places[k] < best):
                best = places[k]
        return best

    for place, c in marks:
        if place < at:
            continue
        at = place
        if at in code:
            found.append((at, code[at], False))
            at = code[at]
            continue
        end = -1
        if c == '"':
            end = partner('"', at)
        elif c in PAIRS:
            end = partner(PAIRS[c], at)
            if end >= 0 and c in "([（":  # nested brackets of the same kind
                end = nested[c].get(at, end)
        if end >= 0:
            found.append((at, end + 1, True))
            at = end + 1
    return found


@dataclass
class Break:
    """A place where a sentence may end, and where the next one begins."""

    end: int
    begin: int
    kind: str  # sure, quote, number, stop, glued
    before: str = ""
    after: str = ""
    quote_from: int = -1


_OPENING = regex.compile(r"[\s\p{Ps}\p{Pi}\"„¿¡*_\-–—]*")
_BLANKS = regex.compile(r"\s*")


class Words:
    """The words of a text, found once: by where they begin and end."""

    def __init__(self, text: str):
        self.text, self.all = text, [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        self.begins = [a for a, _, _ in self.all]

    def _holding(self, at: int) -> tuple[int, int, str]:
        k = bisect_right(self.begins, at) - 1
        return self.all[k] if k >= 0 else (0, 0, "")

    def after(self, at: int) -> str:
        """The word, or rest of one, that begins after the opening marks at ``at``."""
        at = _OPENING.match(self.text, at).end()
        a, b, w = self._holding(at)
        return w[at - a :] if at < b else ""

    def before(self, at: int) -> str:
        """The word, or start of one, that ends at ``at``."""
        a, b, w = self._holding(at - 1)
        return w[: at - a] if at <= b else ""


def breaks(text: str, words: Words | None = None) -> list[Break]:
    """All places where a sentence of a paragraph may end, in order."""
    words = words or Words(text)
    protected = spans(text)
    out: list[Break] = []
    inner, size, outer = 0, len(text), 0
    danda = "।" in text  # where it is used, a full stop after its script only shortens a word
    for m in THAI_GAP.finditer(text):
        while outer < len(protected) and protected[outer][1] <= m.start():
            outer += 1
        if outer == len(protected) or protected[outer][0] > m.start():
            out.append(Break(m.start(), m.end(), "sure"))
    for m in ENDING.finditer(text):
        start, end = m.start(), m.end()
        while inner < len(protected) and protected[inner][1] <= start:
            inner += 1
        within = protected[inner] if inner < len(protected) and protected[inner][0] < start else None
        quote_from = -1
        if within:
            # only marks just before the closing mark of a quotation can end a sentence around it
            if not within[2] or (end != within[1] - 1 and not (end == within[1] - 2 and text[end].isspace())):
                continue
            quote_from, end = within[0], within[1]
        while end < size and text[end] in CLOSERS and not (text[end] in "\"“'’" and end + 1 < size and text[end + 1].isalnum()):
            end += 1
        rest = _BLANKS.match(text, end).end()
        if rest == size:
            continue
        mark, spaced, then = m.group(), rest > end, text[rest]
        if then in ",;:，；：、،؛)）]":
            continue
        after = words.after(rest)
        initial = after[:1]
        opener = then in PAIRS or then in '"¿¡'
        if quote_from >= 0:
            out.append(Break(end, rest, "quote", text[max(0, quote_from - 1) : quote_from], after, quote_from))
            continue
        if set(mark) & set(SURE):
            # a small letter after ? or ! goes on with the sentence, in scripts that have small letters
            if initial.islower() and not opener:
                continue
            out.append(Break(end, rest, "sure"))
            continue
        ideographic = bool(CJK.match(text[start - 1])) if start else False
        if "…" in mark or len(mark.replace(" ", "")) > 1:
            if ideographic or (spaced and not initial.islower()) or opener:
                out.append(Break(end, rest, "sure"))
            continue
        if ideographic or start == 0:
            continue
        before = words.before(start)
        if danda and DANDA_SCRIPT.match(text[start - 1]):
            continue
        if not spaced:
            # a blank is missing: only after a plain small word and before a capitalised one
            plain = before.isalpha() and before.islower() and len(before) > 2 or text[start - 1] in ")]"
            if plain and initial.isupper() and len(after) > 0 and (len(after) == 1 or after[1:2].islower() or after[1:2] in "'’") and "." not in after:
                out.append(Break(end, rest, "glued", before, after))
            continue
        if initial.islower() and not opener:
            continue
        if not before and text[start - 1] not in CLOSERS and text[start - 1] not in "`$":
            continue
        number = before.replace(".", "").replace(",", "").isdigit()
        out.append(Break(end, rest, "number" if number else "stop", before, after))
    out.sort(key=lambda b: b.end)
    return out


def evidence(text: str, words: Words | None = None) -> Counter:
    """Counts of (word, feature) in one block."""
    out: Counter = Counter()
    found = (words or Words(text)).all
    place = "opens"  # where the next word stands, as far as that is certain
    for k, (_, end, w) in enumerate(found):
        follow = text[end : end + 1]
        then = found[k + 1] if k + 1 < len(found) else None
        gap = text[end : then[0]] if then else text[end:]
        small = w[0].islower()
        if small:
            out[w, "small"] += 1
        elif place and w[0].isupper():
            out[w, place] += 1
        if follow == ".":
            tail = gap[1:].strip()
            if then is None and all(c in CLOSERS + SURE + STOPS for c in tail):
                out[w, "stop_last"] += 1
            elif gap[1:2] in (",", ";", ":") or (then and not tail and gap[1:] and then[2][0].islower()) or gap[1:2] in "-~" and gap[1:2]:
                out[w, "stop_inside"] += 1
            elif gap[1:2].isspace():
                out[w, "stop_digit" if then and not tail.strip("([") and then[2][0].isdigit() else "stop_other"] += 1
            if then is not None:
                out[w, "stop_blocks"] = 1
        else:
            out[w, "bare"] += 1
        strong = gap.strip()
        if strong in ("", ","):
            place = "inside"
        elif strong[0] in SURE or (strong == "." and small and len(w) > 3 and w.isalpha() and gap[1:2].isspace()):
            place = "opens"
        else:
            place = ""
    return out


class Judge:
    """Decides breaks from the counts of words in the document and in the corpus."""

    def __init__(self, known: dict[str, tuple[dict, dict]]):
        self.known = known

    def _of(self, word: str, *features: str) -> dict:
        own, corpus = self.known.get(word, ({}, {}))
        picked = {f: own.get(f, 0) for f in features}
        return picked if sum(picked.values()) > 0 else {f: corpus.get(f, 0) for f in features}

    def abbreviation(self, word: str, after: str) -> bool:
        letters = word.replace(".", "")
        if len(letters) == 1 or "." in word and letters.isalpha() and all(len(p) <= 2 for p in word.split(".")):
            return True
        if after[:1].isdigit():
            # most of its stops stand before numbers
            seen = self._of(word, "stop_inside", "stop_digit", "stop_last", "stop_other", "bare")
            stops = seen["stop_inside"] + seen["stop_digit"] + seen["stop_last"] + seen["stop_other"]
            return 2 * (seen["stop_digit"] + seen["stop_inside"]) > stops and (stops > 1 or not seen["bare"])
        seen = self._of(word, "stop_inside", "bare", "stop_last")
        if seen["stop_inside"]:
            return seen["stop_inside"] >= 0.2 * (seen["bare"] + seen["stop_inside"])
        # never without its stop and closing nothing: in many blocks, or before a word that starts no sentences
        corpus = self.known.get(word, ({}, {}))[1]
        blocks = 0 if corpus.get("stop_last", 0) or corpus.get("bare", 0) else corpus.get("stop_blocks", 0)
        return blocks >= ENOUGH or blocks > 0 and after[:1].isupper() and not self.starter(after)

    def ends(self, word: str) -> bool:
        """Whether an abbreviation can close a sentence: it closes paragraphs somewhere."""
        own, corpus = self.known.get(word, ({}, {}))
        return own.get("stop_last", 0) + corpus.get("stop_last", 0) > 0

    def starter(self, word: str) -> bool:
        small = self._of(word.lower(), "small")["small"] if word.lower() != word else 0
        seen = self._of(word, "opens", "inside")
        return small > 0 or seen["opens"] > 0.1 * seen["inside"] and seen["opens"] > 0

    def name(self, word: str) -> bool:
        return not self.starter(word) and self._of(word, "opens", "inside")["inside"] > 0

    def divides(self, b: Break, begin: int, german: bool) -> bool:
        initial = b.after[:1]
        if b.kind == "sure":
            return True
        if b.kind == "quote":
            cased = initial.isupper() or initial.islower()
            return b.quote_from == begin if not cased else initial.isupper()
        if b.kind == "glued":
            seen = self._of(b.before, "stop_inside", "bare")
            return self.starter(b.after) and (seen["bare"] > 0 or not seen["stop_inside"])
        if b.kind == "number":
            if initial.isdigit():
                return False
            return self.starter(b.after) if german and initial.isupper() else True
        if not b.before:
            return True
        if initial.isdigit():
            return not self.abbreviation(b.before, b.after)
        if not self.abbreviation(b.before, b.after):
            return True
        if len(b.before.replace(".", "")) == 1 and b.before.isupper():
            return self.ends(b.before) and self.starter(b.after) and not self.name(b.after)
        return self.ends(b.before) and not self.name(b.after)


def capitalises(words: Words) -> bool:
    """Whether a text writes its nouns with capitals, as German does: a fifth of its words within sentences."""
    inside = [w for k, (a, _, w) in enumerate(words.all) if k and words.text[words.all[k - 1][1] : a].isspace() and w[0].isalpha()]
    return sum(w[0].isupper() and w[1:2].islower() for w in inside) > 0.2 * len(inside) > 0.6


def pieces(text: str, kind: str | None) -> list[Break] | None:
    """The breaks of a block whose lines or whole are its sentences."""
    if kind == "heading":
        return []
    if kind != "list":
        return None
    out, at = [], 0
    for line in text.split("\n")[:-1]:
        at += len(line) + 1
        rest = _BLANKS.match(text, at).end()
        end = len(text[:at].rstrip())
        if rest < len(text) and end and (not out or out[-1].begin < rest):
            out.append(Break(end, rest, "sure"))
    return out


def chosen(begin: int, end: int, marks: list[Break], known: dict[str, tuple[dict, dict]], german: bool) -> list[tuple[int, int]]:
    """The sentences between ``begin`` and ``end``, divided at the breaks that the judge allows."""
    judge, out = Judge(known), []
    for b in marks:
        if b.end > begin and judge.divides(b, begin, german):
            out.append((begin, b.end))
            begin = b.begin
    return [*out, (begin, end)] if end > begin else out


def divide(text: str, kind: str | None, lang: str | None, known: dict[str, tuple[dict, dict]]) -> list[tuple[int, int]]:
    """Start and end of each sentence of a block, in code points."""
    words, fixed = Words(text), pieces(text, kind)
    begin = len(text) - len(text.lstrip())
    return chosen(begin, len(text.rstrip()), breaks(text, words) if fixed is None else fixed, known, lang == "de" or (lang is None and capitalises(words)))


RESULT = pa.schema([("block_id", pa.int64()), ("begin_at", pa.int64()), ("end_at", pa.int64())])
_MARK = pa.struct([("end", pa.int32()), ("begin", pa.int32()), ("kind", pa.string()), ("before", pa.string()), ("after", pa.string()), ("quote_from", pa.int32())])
_READ = pa.schema([
    ("row", pa.int64()), ("block_id", pa.int64()), ("source", pa.string()), ("german", pa.bool_()), ("begin", pa.int32()), ("end", pa.int32()), ("marks", pa.list_(_MARK)),
    ("word", pa.string()), *[(f, pa.int64()) for f in FEATURES],
])
_READ_SQL = (
    "row bigint, block_id bigint, source string, german boolean, begin int, end int, marks array<struct<end int, begin int, kind string, before string, after string, quote_from int>>, word string, "
    + ", ".join(f"{f} bigint" for f in FEATURES)
)


def _read(base: DataFrame) -> DataFrame:
    """One reading of all blocks: a row for each block with its breaks, and rows of counts of the words of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], Counter] = defaultdict(Counter)
            rows = []
            for row, block, source, kind, lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, fixed = Words(text), pieces(text, kind)
                for (word, feature), n in evidence(text, words).items():
                    sums[source, word][feature] += n
                begin, end = len(text) - len(text.lstrip()), len(text.rstrip())
                if end > begin:
                    marks = breaks(text, words) if fixed is None else fixed
                    rows.append((row, block, source, lang == "de" or (lang is None and capitalises(words)), begin, end, [vars(b) for b in marks]))
            keys, n, m = list(sums), len(rows), len(sums)
            columns = [pa.array([r[k] for r in rows] + [None] * m, _READ.types[k]) for k in range(7)]
            columns[2] = pa.array([r[2] for r in rows] + [k[0] for k in keys], pa.string())
            columns.append(pa.array([None] * n + [k[1] for k in keys], pa.string()))
            columns += [pa.array([None] * n + [sums[k][f] for k in keys], pa.int64()) for f in FEATURES]
            yield pa.record_batch(columns, schema=_READ)

    return cut(base.select("row", "block_id", "source", "kind", "lang", "text").mapInArrow(run, _READ_SQL))


def _with_hot(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` left joined with ``facts`` (one row a key, ``n``: how many rows ask for it).

    Keys that very many rows ask for do not go through a shuffle: their facts are broadcast, at
    most ``HOT_PARTS`` of them, since their numbers add up to no more than ``total``.
    """
    hot = max(HOT_LEAST, total // HOT_PARTS)
    few = facts.filter(F.col("n") > hot).drop("n").withColumn("_hot", F.lit(True))
    many = facts.filter(F.col("n") <= hot).drop("n")
    values = [c for c in facts.columns if c not in (*keys, "n")]
    first = rows.join(F.broadcast(few), keys, "left")
    done = first.filter("_hot").select(*rows.columns, *values)
    rest = first.filter("_hot IS NULL").select(*rows.columns).join(many.hint("merge"), keys, "left")
    return done.unionByName(rest)


def split(blocks: DataFrame) -> DataFrame:
    """``block_id, begin_at, end_at`` of every sentence of ``blocks``.

    Needed columns: block_id, kind, source, lang, text. Positions count code points from 0;
    white space around a sentence is left out. Null, empty and blank texts have no
    sentences; a block that occurs twice is divided twice; one without a source is a document
    of its own. Each text is read once, and whole.
    """
    base = spread(blocks.select("block_id", "kind", "source", "lang", "text").filter("text IS NOT NULL"), "block_id")
    base = base.withColumn("row", F.xxhash64("block_id", "kind", "lang", "text", "source"))
    base = base.withColumn("source", F.coalesce("source", F.concat(F.lit("\0"), F.col("row").cast("string"))))
    read = _read(base)
    of_source = read.filter("word IS NOT NULL").groupBy("source", "word").agg(*[F.sum(f).alias(f) for f in FEATURES])
    of_source = cut(of_source)
    of_corpus = of_source.groupBy("word").agg(F.count("*").alias("n"), *[F.sum(f).alias(f"all_{f}") for f in FEATURES])

    texts = read.filter("marks IS NOT NULL").select("row", "block_id", "source", "german", "begin", "end", "marks")
    unsure = F.filter("marks", lambda b: b["kind"] != "sure")
    around = F.transform(unsure, lambda b: F.array(b["before"], b["after"], F.lower(b["after"])))
    asked = texts.select("row", "source", F.explode(F.array_distinct(F.flatten(around))).alias("word")).filter("word <> ''")
    pairs = asked.groupBy("source", "word").agg(F.count("*").alias("n"))
    counts = pairs.agg(F.count("*").alias("pairs"), F.sum("n").alias("rows")).first()
    # sizes are estimated from compressed files, counts of words are many times larger: no join but those of hot keys may broadcast
    own = pairs.join(of_source.hint("merge"), ["source", "word"], "left")
    facts = _with_hot(own, of_corpus, ["word"], of_source.count())
    numbers = [*FEATURES, *[f"all_{f}" for f in FEATURES]]
    answers = _with_hot(asked, facts.select("source", "word", "n", F.array(*[F.coalesce(n, F.lit(0)) for n in numbers]).alias("counts")), ["source", "word"], counts.rows or 0)
    known = answers.groupBy("row").agg(F.collect_list(F.struct("word", F.col("counts").alias("n"))).alias("known"))
    ready = texts.join(known.hint("merge"), "row", "left").select("block_id", "german", "begin", "end", "marks", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(FEATURES)
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for block, german, begin, end, marks, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = {k["word"]: (dict(zip(FEATURES, k["n"][:width], strict=True)), dict(zip(FEATURES, k["n"][width:], strict=True))) for k in known or ()}
                out.extend((block, a, b) for a, b in chosen(begin, end, [Break(**b) for b in marks], words, german))
            yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], schema=RESULT)

    return ready.mapInArrow(run, "block_id bigint, begin_at bigint, end_at bigint")
